"""Word lists, dictionaries, constants and patterns.

Results depend on these exact values; they are data, kept together here.
"""

from __future__ import annotations

# Vocabularies and their URIs.
SYSTEM_URIS = {
    "snomed": "http://snomed.info/sct",
    "loinc": "http://loinc.org",
    "rxnorm": "http://www.nlm.nih.gov/research/umls/rxnorm",
}
IS_A = "116680003"

# Prefixes stripped from terms, in this order.
TERM_PREFIXES = (
    "history of ", "chronic ", "acute ", "suspected ", "possible ", "probable ", "diagnosis of ",
    "patient has ", "patient with ", "underlying ", "recurrent ", "documented ", "confirmed ", "active ",
)

# Lab names.
LAB_PREFIXES = ("test", "lab test", "laboratory test", "analysis", "measurement", "level", "serum", "plasma")
LAB_SUFFIXES = ("test", "level", "count", "measurement", "analysis", "panel", "assay")
LAB_SHORT_NAMES = {
    "hgb": "hemoglobin",
    "hct": "hematocrit",
    "wbc": "leukocyte count",
    "rbc": "erythrocyte count",
    "plt": "platelet count",
    "gluc": "glucose",
    "chol": "cholesterol",
    "creat": "creatinine",
    "bili": "bilirubin",
    "trig": "triglycerides",
    "bun": "urea nitrogen",
    "uric acid": "urate",
    "potassium": "potassium",
    "sodium": "sodium",
    "chloride": "chloride",
    "k": "potassium",
    "na": "sodium",
    "cl": "chloride",
    "hba1c": "hemoglobin a1c",
    "a1c": "hemoglobin a1c",
}
LAB_KEYWORDS = (
    "test", "level", "measurement", "laboratory", "lab", "analysis", "count", "profile", "panel", "assay",
    "culture", "titer", "screen", "ratio", "blood", "serum", "plasma", "urine", "csf", "biopsy",
    "hemoglobin", "glucose", "creatinine", "sodium", "potassium", "calcium", "albumin", "bilirubin",
    "cholesterol", "triglyceride", "ldl", "hdl", "ast", "alt", "ggt", "wbc", "rbc", "platelet",
    "inr", "ptt", "troponin", "bnp", "tsh", "hba1c", "antibody",
)
COMMON_LAB_COMPONENTS = (
    "glucose", "hemoglobin", "creatinine", "potassium", "sodium", "calcium", "chloride", "cholesterol",
    "triglycerides", "protein", "albumin", "bilirubin", "alk phos", "alt", "ast", "ldh", "ggt",
    "tsh", "t3", "t4", "wbc", "rbc", "platelet", "hematocrit",
)

# Drug names.
DOSAGE_FORMS = (
    "tablet", "capsule", "solution", "suspension", "injection", "syrup", "cream", "ointment", "gel",
    "lotion", "patch", "extended release", "er", "xr", "oral", "topical", "film",
)
BRAND_SUFFIXES = ("-hct", "-xr", "-cr", "-sr", "-ir")

# Which synonym sets belong to a vocabulary, by a part of the set's key.
SYNONYM_KEYS = {
    "snomed": ("_syn", "disease", "condition", "disorder", "finding", "procedure", "operation", "surgery"),
    "loinc": ("_test", "_measurement", "_lab", "_assessment", "_scale", "_score"),
    "rxnorm": ("_drug", "_medication", "_antibiotic", "_agent", "_therapy"),
}

# Stopwords.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "because", "as", "what", "when", "where", "how", "who",
    "which", "this", "that", "these", "those", "then", "just", "so", "than", "such", "both", "through",
    "about", "for", "is", "of", "while", "during", "to", "from", "in", "out", "on", "off", "over", "under",
    "again", "further", "once", "here", "there", "all", "any", "each", "few", "more", "most", "other",
    "some", "no", "nor", "not", "only", "own", "same", "too", "very", "s", "t", "can", "will", "don",
    "should", "now", "with", "by",
)

# Variations of a term.
VARIATION_PREFIXES = ("history of ", "chronic ", "acute ", "suspected ", "possible ", "recurrent ")
WORD_REPLACEMENTS = {
    "disease": ("disorder", "syndrome", "condition"),
    "syndrome": ("disease", "disorder", "condition"),
    "disorder": ("disease", "syndrome", "condition"),
    "infection": ("disease", "inflammatory"),
    "neoplasm": ("tumor", "cancer", "mass"),
    "tumor": ("neoplasm", "cancer", "mass"),
    "cancer": ("neoplasm", "tumor", "malignancy"),
    "medication": ("drug", "medicine", "pharmaceutical"),
    "drug": ("medication", "medicine", "pharmaceutical"),
    "examination": ("exam", "assessment", "evaluation"),
    "assessment": ("exam", "examination", "evaluation"),
    "abnormality": ("anomaly", "defect", "malformation"),
    "pain": ("ache", "discomfort", "soreness"),
    "inflammation": ("inflammatory", "itis"),
    "insufficiency": ("deficiency", "failure"),
    "test": ("assay", "analysis", "measurement"),
    "injury": ("trauma", "wound", "damage"),
    "chronic": ("persistent", "long-term", "ongoing"),
    "acute": ("sudden", "severe", "short-term"),
    "elevated": ("increased", "high", "raised"),
    "decreased": ("reduced", "low", "deficient"),
}
VARIATION_ABBREVIATIONS = {
    "MI": ("myocardial infarction", "heart attack"),
    "HTN": ("hypertension", "high blood pressure"),
    "DM": ("diabetes mellitus",),
    "T2DM": ("type 2 diabetes mellitus", "diabetes type 2"),
    "COPD": ("chronic obstructive pulmonary disease",),
    "CHF": ("congestive heart failure", "heart failure"),
    "CAD": ("coronary artery disease",),
    "CVA": ("cerebrovascular accident", "stroke"),
    "UTI": ("urinary tract infection",),
    "GERD": ("gastroesophageal reflux disease", "acid reflux"),
    "RA": ("rheumatoid arthritis",),
    "OA": ("osteoarthritis",),
    "CKD": ("chronic kidney disease",),
    "HLD": ("hyperlipidemia", "high cholesterol"),
    "BPH": ("benign prostatic hyperplasia", "enlarged prostate"),
    "DVT": ("deep vein thrombosis",),
    "PE": ("pulmonary embolism",),
    "ADHD": ("attention deficit hyperactivity disorder",),
    "IBD": ("inflammatory bowel disease",),
    "IBS": ("irritable bowel syndrome",),
    "HA": ("headache",),
    "SOB": ("shortness of breath",),
    "CP": ("chest pain",),
    "BP": ("blood pressure",),
    "Hb A1c": ("hemoglobin a1c", "glycated hemoglobin"),
}
SUFFIX_MEANINGS = {
    "itis": "inflammation",
    "emia": "blood condition",
    "oma": "tumor",
    "osis": "condition",
    "pathy": "disease",
    "megaly": "enlargement",
    "algia": "pain",
    "dynia": "pain",
    "ectomy": "surgical removal",
    "plasty": "surgical repair",
    "otomy": "surgical incision",
    "ostomy": "surgical opening",
    "scopy": "visual examination",
    "graphy": "imaging",
    "gram": "record",
    "trophy": "growth",
}

# Match thresholds.
THRESHOLDS = {"ratio": 90.0, "partial": 95.0, "token_sort": 85.0, "difflib": 0.8, "jaccard": 0.7, "cosine": 0.7}

# Words of a context that raise a score, and by how much.
CONTEXT_KEYWORDS = {
    "medical": (10, (
        "patient", "diagnosis", "medical", "health", "clinical", "disease", "condition", "history",
        "assessment", "treatment", "healthcare", "physician", "doctor", "hospital", "clinic", "symptoms",
    )),
    "condition": (15, (
        "diagnosis", "condition", "disease", "disorder", "syndrome", "diagnosed with", "suffers from",
        "presents with", "symptoms of", "confirmed", "suspected", "chronic", "acute", "patient has",
        "history of", "assessment", "impression",
    )),
    "procedure": (12, (
        "procedure", "surgery", "operation", "intervention", "test", "exam", "scan", "image", "performed",
        "underwent", "scheduled for", "surgical", "diagnostic", "examination", "imaging", "treatment",
    )),
    "medication": (15, (
        "medication", "drug", "dose", "dosage", "tablet", "capsule", "pill", "injection", "infusion",
        "prescription", "mg", "mcg", "mL", "oral", "intravenous", "iv", "im", "subcutaneous", "sc", "daily",
        "bid", "tid", "taken", "prescribed", "therapy", "treatment", "administration",
    )),
    "lab": (15, (
        "laboratory", "lab", "blood test", "urine test", "serum", "plasma", "sample", "specimen", "test",
        "assay", "analysis", "level", "concentration", "chemistry", "hematology", "microbiology", "value",
        "elevated", "decreased", "normal range", "reference range", "results", "panel", "profile",
    )),
    "measurement": (10, (
        "measurement", "measure", "assessment", "evaluate", "monitoring", "value", "level", "test", "testing",
        "parameter", "score", "index", "rate", "ratio", "concentration", "count", "percentage", "mmHg", "kg",
        "cm", "mm", "mmol/L", "mg/dL", "g/L", "frequency", "duration",
    )),
}

# Modifier patterns, in order of detection.
MODIFIER_PATTERNS = {
    "negation": (
        r"\b(?:no|not|without|absent|negative|denies?|rules?\s+out)\b",
        r"\b(?:never|none|nowhere|nothing|nobody)\b",
        r"\b(?:cannot|can't|won't|wouldn't|shouldn't)\b",
    ),
    "uncertainty": (
        r"\b(?:possible|possibly|probable|probably|likely|unlikely)\b",
        r"\b(?:suspect|suspected|consider|considering|rule\s+out)\b",
        r"\b(?:may|might|could|would|should)\b",
        r"\b(?:appears?|seems?|suggests?|consistent\s+with)\b",
    ),
    "past_history": (
        r"\b(?:history\s+of|h/o|hx\s+of|previous|prior|past)\b",
        r"\b(?:formerly|previously|once|used\s+to)\b",
    ),
    "current": (
        r"\b(?:current|currently|present|active|ongoing)\b",
        r"\b(?:now|today|recently|acute)\b",
    ),
    "chronic": (
        r"\b(?:chronic|long-term|persistent|ongoing)\b",
        r"\b(?:lifelong|permanent|established)\b",
    ),
}

# Domain patterns; ties go to the first domain.
DOMAIN_PATTERNS = {
    "cardiology": (
        r"\b(?:heart|cardiac|cardio|coronary|myocardial|pericardial)\b",
        r"\b(?:arrhythmia|tachycardia|bradycardia|fibrillation)\b",
        r"\b(?:ecg|ekg|echo|catheterization|angiogram)\b",
    ),
    "pulmonology": (
        r"\b(?:lung|pulmonary|respiratory|bronchial|alveolar)\b",
        r"\b(?:asthma|copd|pneumonia|bronchitis|emphysema)\b",
        r"\b(?:chest\s+x-ray|ct\s+chest|spirometry)\b",
    ),
    "laboratory": (
        r"\b(?:lab|laboratory|blood|serum|plasma|urine)\b",
        r"\b(?:glucose|cholesterol|hemoglobin|creatinine)\b",
        r"\b(?:test|level|result|value|measurement)\b",
    ),
    "endocrinology": (
        r"\b(?:diabetes|diabetic|insulin|glucose|thyroid)\b",
        r"\b(?:hormone|endocrine|metabolic|adrenal)\b",
        r"\b(?:hba1c|tsh|t3|t4|cortisol)\b",
    ),
}
#: Vocabularies a domain prefers, and the factor on their confidence.
DOMAIN_BOOSTS = {"laboratory": (("loinc",), 1.2), "cardiology": (("snomed",), 1.1), "endocrinology": (("snomed", "loinc"), 1.15)}

# Words of a context that support a concept.
SUPPORTING_CONTEXT = {
    "snomed": {
        "diabetes": ("glucose", "sugar", "a1c", "metformin", "insulin", "glycemic"),
        "hypertension": ("blood pressure", "bp", "systolic", "diastolic", "mmhg"),
        "asthma": ("respiratory", "breathing", "wheeze", "inhaler", "bronchial"),
        "pneumonia": ("lung", "respiratory", "cough", "infection", "fever"),
        "heart": ("cardiac", "chest pain", "cardiovascular", "ecg", "ekg"),
    },
    "loinc": {
        "hemoglobin": ("blood", "cbc", "anemia", "diabetes"),
        "glucose": ("diabetes", "blood sugar", "fasting", "a1c"),
        "cholesterol": ("lipid", "hdl", "ldl", "cardiovascular"),
        "creatinine": ("kidney", "renal", "gfr", "bun"),
    },
    "rxnorm": {
        "metformin": ("diabetes", "hypoglycemic", "glucose", "a1c"),
        "lisinopril": ("hypertension", "blood pressure", "ace inhibitor", "bp"),
        "aspirin": ("antiplatelet", "pain", "blood thinner", "heart", "stroke"),
        "atorvastatin": ("cholesterol", "statin", "lipid", "cardiovascular"),
    },
}

# Entity patterns.
TERM_PATTERNS = (
    r"\b(?:diabetes|hypertension|asthma|pneumonia|covid-19|coronavirus)\b",
    r"\b(?:glucose|hemoglobin|creatinine|cholesterol)\b",
    r"\b(?:metformin|insulin|aspirin|lisinopril)\b",
)
ENTITY_PATTERNS = {
    "dosage": (
        r"\b\d+\s*(?:mg|g|mcg|ug|ml|cc|units?|iu)\b",
        r"\b\d+\s*(?:-|to)\s*\d+\s*(?:mg|g|mcg|ug|ml|cc|units?|iu)\b",
    ),
    "frequency": (
        r"\b(?:once|twice|three\s+times|four\s+times)\s+(?:a\s+)?(?:day|daily|week|weekly|month|monthly)\b",
        r"\b(?:q|every)\s*\d+\s*(?:h|hr|hrs|hours?|d|days?|w|wk|weeks?|mo|months?)\b",
        r"\b(?:bid|tid|qid|qd|qod|prn|ac|pc|hs)\b",
    ),
    "negation": (
        r"\bno\s+(?:evidence|signs?|symptoms?|history)\s+of\b",
        r"\bdenies?\b",
        r"\bnegative\s+for\b",
        r"\bwithout\b",
    ),
}

# Conditions that the offline provider knows.
COMMON_CONDITIONS = {
    "obesity": ("414915002", "Obesity"),
    "diabetes": ("73211009", "Diabetes mellitus"),
    "diabetes mellitus": ("73211009", "Diabetes mellitus"),
    "hypertension": ("38341003", "Hypertension"),
    "coronary artery disease": ("53741008", "Coronary artery disease"),
    "myocardial infarction": ("22298006", "Myocardial infarction"),
    "pneumonia": ("233604007", "Pneumonia"),
    "asthma": ("195967001", "Asthma"),
    "malnutrition": ("248325000", "Malnutrition"),
    "dehydration": ("34095006", "Dehydration"),
    "insomnia": ("193462001", "Insomnia"),
    "angina pectoris": ("194828000", "Angina pectoris"),
    "aortic stenosis": ("60573004", "Aortic stenosis"),
    "endometriosis": ("129103003", "Endometriosis"),
    "benign prostatic hyperplasia": ("266569009", "Benign prostatic hyperplasia"),
    "erectile dysfunction": ("397803000", "Erectile dysfunction"),
}

# Limits of document types, in MB, and of jobs.
MAX_MEGABYTES = {"pdf": 50, "docx": 25, "txt": 10, "rtf": 25, "hl7": 5}
MAX_BATCH_TERMS = 1000

# Abbreviations and their expansions, in order of preference.
ABBREVIATIONS = {
    "htn": ("hypertension", "high blood pressure"),
    "dm": ("diabetes mellitus", "diabetes"),
    "dm2": ("type 2 diabetes mellitus", "diabetes type 2"),
    "dm1": ("type 1 diabetes mellitus", "diabetes type 1"),
    "mi": ("myocardial infarction", "heart attack"),
    "chf": ("congestive heart failure", "heart failure"),
    "afib": ("atrial fibrillation", "a fib"),
    "aflutter": ("atrial flutter",),
    "copd": ("chronic obstructive pulmonary disease", "chronic obstructive lung disease"),
    "cad": ("coronary artery disease", "coronary disease"),
    "cvd": ("cardiovascular disease",),
    "cva": ("cerebrovascular accident", "stroke"),
    "tia": ("transient ischemic attack", "mini stroke"),
    "dvt": ("deep vein thrombosis", "deep venous thrombosis"),
    "pe": ("pulmonary embolism", "pulmonary embolus"),
    "gerd": ("gastroesophageal reflux disease", "acid reflux"),
    "ibs": ("irritable bowel syndrome",),
    "uti": ("urinary tract infection",),
    "uri": ("upper respiratory infection",),
    "lri": ("lower respiratory infection",),
    "ards": ("acute respiratory distress syndrome",),
    "ckd": ("chronic kidney disease",),
    "esrd": ("end stage renal disease",),
    "aki": ("acute kidney injury",),
    "arf": ("acute renal failure",),
    "crf": ("chronic renal failure",),
    "ra": ("rheumatoid arthritis",),
    "oa": ("osteoarthritis",),
    "sle": ("systemic lupus erythematosus", "lupus"),
    "ms": ("multiple sclerosis",),
    "pd": ("parkinson disease", "parkinson's disease"),
    "ad": ("alzheimer disease", "alzheimer's disease"),
    "als": ("amyotrophic lateral sclerosis", "lou gehrig disease"),
    "gi": ("gastrointestinal",),
    "gi bleed": ("gastrointestinal bleeding", "gastrointestinal hemorrhage"),
    "ugib": ("upper gastrointestinal bleeding",),
    "lgib": ("lower gastrointestinal bleeding",),
    "pud": ("peptic ulcer disease",),
    "gib": ("gastrointestinal bleeding",),
    "hep": ("hepatitis",),
    "hep a": ("hepatitis a",),
    "hep b": ("hepatitis b",),
    "hep c": ("hepatitis c",),
    "nstemi": ("non st elevation myocardial infarction",),
    "stemi": ("st elevation myocardial infarction",),
    "cabg": ("coronary artery bypass graft", "coronary artery bypass surgery"),
    "pci": ("percutaneous coronary intervention",),
    "ptca": ("percutaneous transluminal coronary angioplasty",),
    "bph": ("benign prostatic hyperplasia", "benign prostatic hypertrophy"),
    "cap": ("community acquired pneumonia",),
    "hap": ("hospital acquired pneumonia",),
    "vap": ("ventilator associated pneumonia",),
    "mrsa": ("methicillin resistant staphylococcus aureus",),
    "vre": ("vancomycin resistant enterococcus",),
    "c diff": ("clostridium difficile", "clostridioides difficile"),
    "cdiff": ("clostridium difficile", "clostridioides difficile"),
    "sob": ("shortness of breath", "dyspnea"),
    "doe": ("dyspnea on exertion",),
    "pnd": ("paroxysmal nocturnal dyspnea",),
    "cp": ("chest pain",),
    "abd": ("abdomen", "abdominal"),
    "n/v": ("nausea and vomiting",),
    "n&v": ("nausea and vomiting",),
    "ha": ("headache",),
    "loc": ("loss of consciousness",),
    "sz": ("seizure",),
    "fx": ("fracture",),
    "tx": ("treatment", "therapy"),
    "dx": ("diagnosis",),
    "sx": ("symptoms",),
    "hx": ("history",),
    "pmh": ("past medical history",),
    "psh": ("past surgical history",),
    "fh": ("family history",),
    "sh": ("social history",),
    "ros": ("review of systems",),
    "bp": ("blood pressure",),
    "hr": ("heart rate",),
    "rr": ("respiratory rate",),
    "temp": ("temperature",),
    "o2": ("oxygen",),
    "o2 sat": ("oxygen saturation",),
    "spo2": ("oxygen saturation", "pulse oximetry"),
    "wbc": ("white blood cell", "white blood cells"),
    "rbc": ("red blood cell", "red blood cells"),
    "hgb": ("hemoglobin",),
    "hct": ("hematocrit",),
    "plt": ("platelet", "platelets"),
    "inr": ("international normalized ratio",),
    "ptt": ("partial thromboplastin time",),
    "aptt": ("activated partial thromboplastin time",),
    "ast": ("aspartate aminotransferase",),
    "alt": ("alanine aminotransferase",),
    "alk phos": ("alkaline phosphatase",),
    "bili": ("bilirubin",),
    "cr": ("creatinine",),
    "bun": ("blood urea nitrogen",),
    "gfr": ("glomerular filtration rate",),
    "egfr": ("estimated glomerular filtration rate",),
    "na": ("sodium",),
    "k": ("potassium",),
    "cl": ("chloride",),
    "co2": ("carbon dioxide", "bicarbonate"),
    "mg": ("magnesium",),
    "ca": ("calcium",),
    "phos": ("phosphorus",),
    "tsh": ("thyroid stimulating hormone",),
    "t3": ("triiodothyronine",),
    "t4": ("thyroxine",),
    "hba1c": ("hemoglobin a1c", "glycated hemoglobin"),
    "ldl": ("low density lipoprotein",),
    "hdl": ("high density lipoprotein",),
    "tg": ("triglyceride", "triglycerides"),
    "tc": ("total cholesterol",),
    "ekg": ("electrocardiogram", "ecg"),
    "ecg": ("electrocardiogram", "ekg"),
    "echo": ("echocardiogram", "echocardiography"),
    "cxr": ("chest x-ray", "chest radiograph"),
    "ct": ("computed tomography", "cat scan"),
    "mri": ("magnetic resonance imaging",),
    "us": ("ultrasound", "ultrasonography"),
    "cbc": ("complete blood count",),
    "bmp": ("basic metabolic panel",),
    "cmp": ("comprehensive metabolic panel",),
    "lfts": ("liver function tests",),
    "ua": ("urinalysis",),
    "abx": ("antibiotics",),
    "nsaid": ("nonsteroidal anti-inflammatory drug",),
    "nsaids": ("nonsteroidal anti-inflammatory drugs",),
    "ace": ("angiotensin converting enzyme",),
    "acei": ("angiotensin converting enzyme inhibitor",),
    "arb": ("angiotensin receptor blocker",),
    "bb": ("beta blocker",),
    "ccb": ("calcium channel blocker",),
    "ppi": ("proton pump inhibitor",),
    "ssri": ("selective serotonin reuptake inhibitor",),
    "snri": ("serotonin norepinephrine reuptake inhibitor",),
    "tca": ("tricyclic antidepressant",),
    "maoi": ("monoamine oxidase inhibitor",),
    "asa": ("aspirin", "acetylsalicylic acid"),
    "apap": ("acetaminophen",),
    "pcn": ("penicillin",),
    "vanco": ("vancomycin",),
    "levo": ("levofloxacin",),
    "cipro": ("ciprofloxacin",),
    "azithro": ("azithromycin",),
    "metro": ("metronidazole",),
    "icu": ("intensive care unit",),
    "ed": ("emergency department",),
    "er": ("emergency room",),
    "or": ("operating room",),
    "pacu": ("post anesthesia care unit",),
    "npo": ("nothing by mouth",),
    "po": ("by mouth", "oral"),
    "iv": ("intravenous",),
    "im": ("intramuscular",),
    "sq": ("subcutaneous",),
    "subq": ("subcutaneous",),
    "prn": ("as needed",),
    "bid": ("twice daily",),
    "tid": ("three times daily",),
    "qid": ("four times daily",),
    "qd": ("daily", "once daily"),
    "qhs": ("at bedtime",),
    "qam": ("every morning",),
    "ac": ("before meals",),
    "pc": ("after meals",),
    "stat": ("immediately",),
    "asap": ("as soon as possible",),
}
