"""Fixed values.

Every constant here must have exactly this value for results to agree with the
expected behaviour: limits, word lists, patterns, formats and literal texts.
They are data, kept in their natural order; the logic lives elsewhere.
"""

# --- fixed values: domains and routing --------------------------------------
DOMAINS = ("financial", "medical", "general")
COLLECTION_PREFIX = "rag_"
CHUNK_ID_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"

# --- fixed values: limits ----------------------------------------------------
CHUNK_CHARS = {"general": 800, "financial": 512, "medical": 384}
CHUNK_OVERLAP = 32
HARD_CAP_CHARS = 2000
MAX_TABLE_CHARS = 2048
TOP_K_DENSE = 20
TOP_K_SPARSE = 20
TOP_K_FUSED = 40
TOP_K_RERANKED = 5
RRF_K = 60
CONTEXT_TOKENS = 8192
ANSWER_TOKENS = 1024
SCAFFOLD_TOKENS = 64
BUDGET_CHARS_PER_TOKEN = 3.5
VECTOR_WIDTH = {"general": 384, "financial": 768, "medical": 768}
QUANTILE = 0.99
MAX_QUERY_CHARS = 2000
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
TASK_TTL_SECONDS = 86_400
HISTORY_MESSAGES = 11
RATE_LIMITS = {"global": (60, 60), "ingest": (60, 10), "auth": (900, 20)}  # (seconds, requests)
RATE_LIMIT_EXEMPT_PATH = "/health"
SEMANTIC_CACHE_THRESHOLD = 0.92
SEMANTIC_CACHE_TTL_SECONDS = 3600

# --- fixed values: files -----------------------------------------------------
ALLOWED_EXTENSIONS = (".pdf", ".docx", ".doc", ".html", ".htm", ".txt", ".md")
ALLOWED_MIME_TYPES = (
    "application/pdf",
    "text/plain",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
)

# --- fixed values: characters and tokens --------------------------------------
# White space as understood by Unicode-aware trimming.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"

# --- fixed values: sentence boundaries ----------------------------------------
SENTENCE_GENERAL = r"(?<=[.!?])\s+(?=[A-Z\"'(])"
SENTENCE_MEDICAL = r"(?<=[.?!])\s+(?=[A-Z\"(])"
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "vs", "etc",
    "Corp", "Ltd", "Inc", "LLC", "Co", "No", "pp", "Fig", "Eq", "Sec",
)

# --- fixed values: paragraph kinds --------------------------------------------
HEADER_GENERAL = r"^(?:[A-Z][A-Z\s]{3,}:?\s*$|#{1,3}\s+.+|\d+\.\s+[A-Z].+:?\s*$)"
LIST_GENERAL = r"^[\s]*[-•·*]\s+\S"
HEADER_FINANCIAL = r"^(?:PART\s+[IVXLC]+|Item\s+\d+[A-Z]?\.|Note\s+\d+|SECTION\s+\d+)"
FOOTNOTE_FINANCIAL = r"^\s*(?:\(\d+\)|\d+\.|\*{1,3}|†|‡)\s+"
LIST_FINANCIAL = r"^(?:[•\-*·]|\d+\.)"
TABLE_MIN_PIPES = 5
HEADER_MEDICAL = (
    r"^(?:(?:[A-Z][A-Z\s&/]{3,}:?\s*$)|(?:\d+\.\s+[A-Z][a-zA-Z\s]+:?\s*$)|(?:#{1,3}\s+.+))"
)
LIST_MEDICAL = r"^[\s]*[-•·*]\s+[A-Za-z]"
LIST_ITEM_BREAK = r"\n(?=\s*[-•·*])"
TABLE_SEPARATOR_CELL = r"^:?-+:?$"

ELEMENT_KINDS = {
    "general": {
        "Title": "header",
        "Header": "header",
        "NarrativeText": "narrative",
        "ListItem": "list",
        "Table": "narrative",
        "UncategorizedText": "narrative",
    },
    "financial": {
        "Table": "table",
        "Title": "header",
        "NarrativeText": "narrative",
        "ListItem": "list",
        "FigureCaption": "narrative",
        "Header": "header",
        "Footer": "footnote",
        "UncategorizedText": "narrative",
    },
    "medical": {
        "Title": "header",
        "Header": "header",
        "NarrativeText": "narrative",
        "ListItem": "list",
        "Table": "narrative",
        "UncategorizedText": "narrative",
    },
}

# --- fixed values: clinical sections, first match wins (case-insensitive) -------
SECTION_DEFAULT = "General"
SECTION_MEDICATIONS = "Medications & Dosage"
SECTIONS = (
    (r"\b(chief\s+complaint|presenting\s+(symptom|complaint)|symptoms?|signs?\s+and\s+symptoms?)\b", "Symptoms & Chief Complaint"),
    (r"\b(assessment|diagnos[ie]s|impression|differential|icd[-\s]?\d+)\b", "Diagnosis & Assessment"),
    (r"\b(treatment\s+plan|plan|management|therapeutic|intervention|therapy)\b", "Treatment & Plan"),
    (r"\b(medication|drug|prescription|dosage|dose|formulary|pharmacolog|NDC\b)\b", "Medications & Dosage"),
    (r"\b(adverse\s+(reaction|event|effect)|side\s+effect|contraindication|warning|black\s+box|REMS\b)\b", "Adverse Reactions & Warnings"),
    (r"\b(lab(oratory)?|result|finding|CBC|CMP|HbA1c|troponin|creatinine|eGFR|INR|TSH|culture|biopsy|patholog)\b", "Lab Results & Diagnostics"),
    (r"\b(history|past\s+medical|PMH|HPI|review\s+of\s+systems|ROS|family\s+history|social\s+history)\b", "Medical History"),
    (r"\b(procedure|surgery|operation|intervention|catheter|endoscop|radiolog|imaging|MRI|CT\s+scan|X-ray)\b", "Procedures & Interventions"),
)

# --- fixed values: clinical entities, in order; the flag says case-insensitive ---
ENTITY_MIN_CHARS = 3
ENTITIES = (
    (r"\b[a-zA-Z][a-zA-Z\-]+\s+\d+(?:\.\d+)?\s*(?:mg|mcg|µg|g|mL|IU|units?|mmol)(?:/\w+)?(?:\s+(?:once|twice|three\s+times?|q\d+h|QD|BID|TID|QID|PRN|daily|weekly))?", True),
    (r"\b(?:HbA1c|eGFR|INR|TSH|CRP|ESR|PSA|BMI|BP|HR|SpO2|PaO2|pH)\s*[<>=≤≥]?\s*\d+(?:\.\d+)?\s*(?:%|mmHg|mL/min(?:/\S+)?|ng/[mµ]L|IU/L|mg/dL|mmol/L)?", True),
    (r"\b(?:Type\s+[12I]{1,3}\s+Diabetes(?:\s+Mellitus)?|COVID-19|SARS-CoV-2|Non-?Hodgkin(?:'s)?\s+Lymphoma|Chronic\s+Kidney\s+Disease|Congestive\s+Heart\s+Failure|Acute\s+Myocardial\s+Infarction|Atrial\s+Fibrillation|Crohn(?:'s)?\s+Disease|Multiple\s+Sclerosis|Parkinson(?:'s)?\s+Disease|Alzheimer(?:'s)?\s+Disease|Systemic\s+Lupus\s+Erythematosus|Rheumatoid\s+Arthritis)", True),
    (r"\b[A-Z]\d{2}(?:\.\d{1,4})?\b", False),
    (r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)?\s+\d+(?:\.\d+)?\s*(?:mg|mcg|g|mL)(?:\s+(?:tablet|capsule|injection|inhaler|patch|solution|suspension))?", True),
    (r"\b(?:BNT162b2|mRNA-1273|ChAdOx1|Ad26\.COV2\.S|JNJ-78436735)\b", True),
    (r"\b(?:BRCA[12]|HER[23]|EGFR|ALK|KRAS|BRAF|PD-L1|PD-1|TP53|MLH1)\b", False),
)

# --- fixed values: query checks (case-insensitive) -------------------------------
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?(previous|above|prior)\s+instructions?",
    r"(you\s+are\s+now|act\s+as|pretend\s+(you\s+are|to\s+be))\s+",
    r"(system|assistant|user)\s*:\s*",
    r"<\s*(system|assistant|INST|s)\s*>",
    r"\[/?INST\]",
    r"#{3,}",
)
WARN_LONG = "Query exceeds 2000 characters"
WARN_INJECTION_PREFIX = "Potential prompt injection detected (pattern: "
WARN_INJECTION_SUFFIX = ")"
WARN_PATTERN_CHARS = 40
DIAGNOSIS_REQUEST = (
    r"\b(do\s+i\s+have|am\s+i\s+(?:sick|ill|infected)|is\s+this\s+(?:cancer|diabetes|covid)|"
    r"what(?:'s|\s+is)\s+wrong\s+with\s+me|should\s+i\s+take|can\s+i\s+take)\b"
)
WARN_DIAGNOSIS = (
    "Query appears to request a personal medical diagnosis — "
    "response will include professional-referral instruction."
)
NOTE_DIAGNOSIS = (
    "\n⚠️ **Note to model**: This query appears to request a personal "
    "medical diagnosis or treatment recommendation. Respond according "
    "to Rule 1: provide general clinical information from the retrieved "
    "documents only, and direct the user to a licensed healthcare "
    "professional for personal medical decisions.\n"
)

# --- fixed values: response checks ------------------------------------------------
EMPTY_RESPONSE = (
    "I was unable to generate a response based on the available information. "
    "Please rephrase your question or consult the source documents directly."
)
FORWARD_LOOKING_TRIGGERS = (
    "will ", "expect", "anticipat", "project", "forecast",
    "guidance", "outlook", "plan to", "intend", "believe",
)
FORWARD_LOOKING_NOTICE = (
    "⚠️ **Forward-Looking Statement Notice**: The following response "
    "may contain forward-looking statements. Such statements involve "
    "known and unknown risks, uncertainties, and other factors that "
    "could cause actual results to differ materially from those expressed "
    "or implied. See the company's SEC filings for a complete discussion "
    "of risk factors.\n\n"
)
SENSITIVE_TOPICS = (
    r"\b(suicid|self[- ]?harm|self[- ]?injur|eating\s+disorder|anorexia|bulimia|"
    r"overdos|substance\s+(use|abuse)|opioid|addiction|depression|anxiety|"
    r"psychosis|schizophrenia|bipolar)\b"
)
CRISIS_REFERRAL = (
    "If you or someone you know is in distress, please reach out for help. "
    "In India, you can call the Kiran Helpline at 1800-599-0019 or emergency services at 112."
)
DOSE = r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|µg|g|mL|IU|units?)\b"
PRESCRIBING_NOTE = (
    "For complete prescribing information, dosage adjustments, contraindications, "
    "and drug interactions, refer to the officially approved prescribing information "
    "or consult a licensed pharmacist or physician."
)
MEDICAL_DISCLAIMER = (
    "MEDICAL DISCLAIMER: This information is for educational purposes only and is "
    "not medical advice. Consult a healthcare professional before making clinical decisions. "
    "In an emergency, call 108 or 112 immediately."
)
GENERAL_DISCLAIMER = (
    "Note: This response is generated by an AI system based solely on the "
    "retrieved documents provided above. It may not reflect the most current "
    "information. Verify important facts with primary sources."
)
DISCLAIMER_RULE = "\n\n---\n"

# --- fixed values: prompt texts -----------------------------------------------------
NO_CONTEXT_ANSWER = (
    "The document does not contain sufficient information to answer this question."
)
EMPTY_CONTEXT = {
    "general": "_No relevant documents were retrieved for this query._",
    "financial": "_No relevant documents were retrieved for this query._",
    "medical": "_No relevant clinical documents were retrieved for this query._",
}
CONTEXT_LABELS = {
    "general": ("### Document [", "- **Source Name**: ", "- **Section**: "),
    "financial": (
        "### Retrieved Document [",
        "- **Source**: ",
        "- **Section**: ",
        "- **Date**: ",
        "- **Chunk type**: ",
        "- **Relevance score**: ",
    ),
    "medical": (
        "### Retrieved Document [",
        "- **Source**: ",
        "- **Clinical Section**: ",
        "- **Date / Version**: ",
        "- **Chunk type**: ",
        "- **Detected entities**: ",
        "- **Relevance score**: ",
    ),
}
TABLE_HINT = "[TABLE{rows} — read each cell value carefully]\n\n"
MEDICATION_HINT = (
    "[MEDICATION ENTRY — dosage values are from the source document; "
    "do not personalise for individual patients]\n\n"
)
NO_ENTITIES = "none detected"
NOT_AVAILABLE = "N/A"
UNKNOWN_SOURCE = "unknown"
INSTRUCTION = {
    "general": (
        "Remember: Do not use raw UUIDs. Synthesize the answer logically and "
        "use bullet points for lists."
    ),
    "financial": (
        "Base your entire answer strictly on the provided context. "
        "Do NOT use bracketed citation tags (e.g., [Source: ...]). "
        "Synthesize the information into a cohesive, professional, concise, and readable response. "
        "If the context does not contain the answer, state that explicitly without guessing."
    ),
    "medical": (
        "Base your entire answer strictly on the provided context. "
        "Do NOT use bracketed citation tags (e.g., [Source: ...]). "
        "Synthesize the information into a cohesive, professional, concise, and readable clinical response. "
        "If the context does not contain the answer, state that explicitly without guessing."
    ),
}
# Prompt frames: {n} excerpts, {today}; see operators.render.
CONTEXT_HEADING = {
    "general": "## Retrieved Documents ({n} total) — {today}",
    "financial": (
        "## Retrieved Context\nThe following {n} document excerpt(s) have been retrieved as "
        "relevant to the query. Today's date is {today}."
    ),
    "medical": (
        "## Retrieved Clinical Context\nThe following {n} document excerpt(s) were retrieved as "
        "relevant. Today's date is {today}."
    ),
}
QUERY_HEADING = {"general": "## Question", "financial": "## User Query", "medical": "## User Query"}

# --- fixed values: registry and status -------------------------------------------------
STATUS_START = "pending"
STATUS_TRANSITIONS = (
    ("pending", "processing"),
    ("pending", "failed"),
    ("processing", "completed"),
    ("processing", "failed"),
)
FAILED_DEFAULT_MESSAGE = "Ingestion failed."

# System prompts are configuration, one text per domain; callers pass their own.
SYSTEM_PROMPTS = {
    "general": "Answer the question from the listed documents only and say when they do not hold the answer.",
    "financial": "Answer from the listed filings only, quote every figure as written and name its fiscal period.",
    "medical": "Give general clinical information from the listed documents only; never diagnose or prescribe.",
}
