"""Patterns and small tables of the report grammar. Results depend on each of them."""

from __future__ import annotations

NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
QUALITATIVE = r"(?:Negative|Positive|Reactive|Non[- ]?Reactive|Present|Absent)"
UNIT = r"(?:m?gm?/d[lL]|m?gm?/m[lL]|gm?/[lL]|[npµuμ]g/m[lL]|[npµuμ]g/d[lL]|[npµuμ]g/[lL]|m?cg/d[lL]|m?cg/m[lL]|m?cg/[lL]|m?IU/m[lL]|m?IU/[lL]|[µuμ]IU/m[lL]|m?U/m[lL]|m?U/[lL]|[npµuμ]?mol/[lL]|mol/[lL]|m[Ee]q/[lL]|cells/[uµμ]?[lL]|cells/c?umm|million/[uµμ][lL]|million/c?umm|lakhs/c?umm|thousand/c?umm|/cumm|/mm3|/mm³|/[uµμ][lL]|/HPF|/hpf|[xX]\s?10\s?\^?\s?[36]\s?/\s?[uµμ]?[lL]|X\s?10[³⁶]\s?/?\s?[uµμ]?[lL]|fL|fl|pg|ng|µg|ug|μg|mcg|mg%|gm%|mg|kg|sec(?:onds)?|secs?|mins?|hrs?|hours?|mm/hr|mm/h|mL/min(?:/1\.73m[²2])?|%)"
FLAG = r"(?:H|L|\*|HIGH|LOW|CRITICAL|ABNORMAL)"
FLAG_INSIDE = r"(?:\b(?:H|L|HIGH|LOW|CRITICAL|ABNORMAL)\b|\*)"
SPAN = r"(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)"
COMPARISON = r"(<=|>=|<|>|≤|≥)\s*(\d+(?:\.\d+)?)"
HEADER_SHAPE = r"^[A-Z0-9][A-Z0-9 \-&/()]*$|^[A-Z][a-z]+(?:[ \-&/()][A-Z][a-z]+)*$"
PAGE_MARKER = r"(?i)^Page\s*:?\s*\d+\s+of\s+\d+$"
SEPARATOR = r"^[\s\-_=]*$"
LEADING = r"^[\d<>+\-.≤≥]"

MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}

# Severity that a flag stands for, and the order of severities in a report.
FLAG_SEVERITY = {"h": "high", "high": "high", "l": "low", "low": "low", "hh": "critical-high", "ll": "critical-low", "*": "high", "**": "critical-high", "a": "high", "abnormal": "high"}
SEVERITIES = ("critical-high", "critical-low", "high", "low", "borderline-high", "borderline-low")
MEANINGS = {
    "critical-high": "Significantly above the normal range",
    "critical-low": "Significantly below the normal range",
    "high": "Above normal range",
    "low": "Below normal range",
    "borderline-high": "Slightly above the upper reference limit",
    "borderline-low": "Slightly below the lower reference limit",
    "normal": "Within normal range",
}

# Sections: headings that are noise, product names, other names, and the known panels.
NOISE_SECTIONS = (r"^test\s+asked\b", r"^tests?\s+package\b", r"^hba\s+profile\b", r"^package\s+details?\b", r"^report\s+remarks?\b", r"^note\s*:", r"^important\s+note\b", r"^disclaimer\b", r"^test\s+summary\b", r"^vitamins\s*&\s*$", r"\bscan\s+qr\b", r"\bdoctor'?s?\s+note\b", r"^panel\s+name\b", r"\blab\s+info(rmation)?\b", r"^patient\s+information\b", r"^sample\s+information\b", r"\breference\s+lab\b", r"^interpretation\s+guide\b")
PSEUDO_SECTIONS = (r"\baarogyam\b", r"\barogyam\b", r"\bpro\s*\d*\b", r"\bbasic\s*\d*\b", r"\badvanced\s*\d*\b", r"\bcomprehensive\s*\d*\b", r"^\d+\s+tests?\b", r"\bcheck[\s-]?up\b", r"\bfull\s+body\b", r"\bwellness\s+(package|profile|plan)\b", r"\bmaster\s+health\b", r"\bpremium\s+health\b", r"\bhealth\s+(package|bundle|plan)\b", r"\bspecial\s+package\b")
SECTION_ALIASES = {
    "cbc": "Complete Blood Count", "hemogram": "Complete Blood Count", "haemogram": "Complete Blood Count", "dlc": "Differential Count", "rft": "Renal Function Test", "kft": "Renal Function Test", "lft": "Liver Function Test", "tft": "Thyroid Function Test", "lipids": "Lipid Profile", "cholesterol panel": "Lipid Profile", "kidney function": "Renal Function Test", "kidney function test": "Renal Function Test", "renal function": "Renal Function Test", "metabolic panel": "Biochemistry", "comprehensive metabolic panel": "Biochemistry", "basic metabolic panel": "Biochemistry", "urine r/m": "Urine Routine", "urine routine and microscopy": "Urine Routine", "urinalysis": "Urine Routine", "urine analysis": "Urine Routine", "inflammatory markers": "Inflammation Markers", "iron studies": "Iron Profile",
}
KNOWN_SECTIONS = (
    "complete blood count", "cbc", "hemogram", "haemogram", "complete hemogram", "complete haemogram", "differential count", "differential leukocyte count", "dlc", "absolute count", "biochemistry", "metabolic panel", "comprehensive metabolic panel", "basic metabolic panel", "renal function test", "renal function", "kidney function test", "kidney function", "rft", "kft", "liver function test", "liver function", "lft", "thyroid function test", "thyroid function", "tft", "lipid profile", "lipid panel", "lipids", "cholesterol panel", "vitamins", "minerals", "electrolytes", "serum electrolytes", "iron studies", "iron profile", "bone profile", "hormones", "hormone panel", "thyroid panel", "reproductive hormones", "fertility panel", "adrenal panel", "cardiac panel", "cardiac markers", "cardiac risk markers", "heart markers", "diabetes panel", "diabetic profile", "glycemic panel", "urine routine", "urine r/m", "urine routine and microscopy", "urinalysis", "urine analysis", "infection panel", "inflammation markers", "inflammatory markers", "coagulation", "coagulation profile", "uncategorized",
)
SMALL_WORDS = ("and", "or", "of", "the", "a", "an", "in", "at", "for", "to", "by", "with")

# Analytes of each category; a name's category overrides the heading it stood under.
CATEGORIES = {
    "Diabetes": ("HbA1c", "Glucose (Fasting)", "Glucose (Random)", "Glucose (Post Prandial)", "Estimated Average Glucose"),
    "Lipid Profile": ("Total Cholesterol", "HDL Cholesterol", "LDL Cholesterol", "VLDL Cholesterol", "Triglycerides", "Cholesterol/HDL Ratio", "LDL/HDL Ratio", "HDL/LDL Ratio", "TRIG/HDL Ratio", "Non-HDL Cholesterol"),
    "Renal Function Test": ("Blood Urea Nitrogen", "Urea", "Creatinine", "eGFR", "BUN/Creatinine Ratio", "Uric Acid"),
    "Liver Function": ("Total Bilirubin", "Direct Bilirubin", "Indirect Bilirubin", "AST", "ALT", "AST/ALT Ratio", "Alkaline Phosphatase", "GGT", "Total Protein", "Albumin", "Globulin", "A/G Ratio"),
    "Thyroid Function": ("TSH", "T3", "T4", "Free T3", "Free T4"),
    "Complete Blood Count": ("Hemoglobin", "Hematocrit", "Red Blood Cells", "White Blood Cells", "Platelets", "Mean Corpuscular Volume", "Mean Corpuscular Hemoglobin", "Mean Platelet Volume", "Mean Corpuscular Hemoglobin Concentration", "Red Cell Distribution Width", "Neutrophils", "Lymphocytes", "Monocytes", "Eosinophils", "Basophils"),
    "Vitamins": ("Vitamin D", "Vitamin B12", "Folate"),
    "Bone Health": ("Calcium", "Ionized Calcium", "Phosphorus"),
    "Iron Profile": ("Iron", "Ferritin", "TIBC", "Transferrin Saturation"),
    "Infection Panel": ("ESR",),
    "Hormone Profile": ("Testosterone", "Free Testosterone", "Estradiol", "LH", "FSH", "Prolactin"),
}
# Other names of analytes; a caller may hand in a larger table.
SYNONYMS = {
    "hb": "Hemoglobin", "hgb": "Hemoglobin", "haemoglobin": "Hemoglobin", "hct": "Hematocrit", "pcv": "Hematocrit", "rbc": "Red Blood Cells", "rbc count": "Red Blood Cells", "wbc": "White Blood Cells", "tlc": "White Blood Cells", "plt": "Platelets", "platelet count": "Platelets", "mcv": "Mean Corpuscular Volume", "mch": "Mean Corpuscular Hemoglobin", "mpv": "Mean Platelet Volume", "rdw": "Red Cell Distribution Width", "sgot": "AST", "sgpt": "ALT", "alp": "Alkaline Phosphatase", "tsh": "TSH", "ft3": "Free T3", "ft4": "Free T4", "fbs": "Glucose (Fasting)", "fasting blood sugar": "Glucose (Fasting)", "rbs": "Glucose (Random)", "ppbs": "Glucose (Post Prandial)", "ldl": "LDL Cholesterol", "hdl": "HDL Cholesterol", "vldl": "VLDL Cholesterol", "cholesterol": "Total Cholesterol", "tg": "Triglycerides", "bun": "Blood Urea Nitrogen", "25-oh vitamin d": "Vitamin D", "b12": "Vitamin B12", "esr": "ESR", "estimated": "Estimated Average Glucose",
}

# Spellings of units, by their upper case (µ is U+039C there); a caller may hand in a larger table.
UNITS = {
    "MG/DL": "mg/dL", "GM/DL": "g/dL", "G/DL": "g/dL", "UG/DL": "µg/dL", "ΜG/DL": "µg/dL", "MCG/DL": "µg/dL", "NG/DL": "ng/dL", "NG/ML": "ng/mL", "PG/ML": "pg/mL", "UG/ML": "µg/mL", "ΜG/ML": "µg/mL", "MCG/ML": "µg/mL", "MG/L": "mg/L", "GM/L": "g/L", "G/L": "g/L", "UG/L": "µg/L", "ΜG/L": "µg/L", "NG/L": "ng/L", "PG/DL": "pg/dL", "MG%": "mg%", "GM%": "g%",
    "MMOL/L": "mmol/L", "UMOL/L": "µmol/L", "ΜMOL/L": "µmol/L", "MCMOL/L": "µmol/L", "NMOL/L": "nmol/L", "PMOL/L": "pmol/L", "MOL/L": "mol/L", "MEQ/L": "mEq/L",
    "IU/L": "IU/L", "U/L": "U/L", "IU/ML": "IU/mL", "U/ML": "U/mL", "MIU/L": "mIU/L", "MIU/ML": "mIU/mL", "UIU/ML": "µIU/mL", "ΜIU/ML": "µIU/mL", "MCIU/ML": "µIU/mL",
    "CELLS/CUMM": "cells/cumm", "/CUMM": "/cumm", "CELLS/UL": "cells/µL", "CELLS/ΜL": "cells/µL", "/UL": "/µL", "/ΜL": "/µL", "/HPF": "/HPF", "MILLION/CUMM": "million/cumm", "MILLION/UL": "million/µL", "LAKHS/CUMM": "lakhs/cumm", "THOUSAND/CUMM": "thousand/cumm", "10^3/UL": "10^3/µL", "10^6/UL": "10^6/µL", "10^9/L": "10^9/L", "10^12/L": "10^12/L", "X 10^3/UL": "10^3/µL", "X 10^6/UL": "10^6/µL", "X 10^3 / UL": "10^3/µL", "X 10^6 / UL": "10^6/µL", "X 10³ / UL": "10^3/µL", "X 10⁶ / UL": "10^6/µL", "X 10³/UL": "10^3/µL", "X 10⁶/UL": "10^6/µL", "X 10³ / ΜL": "10^3/µL", "X 10⁶ / ΜL": "10^6/µL", "X 10^6/ΜL": "10^6/µL", "X 10^3/ΜL": "10^3/µL",
    "FL": "fL", "PG": "pg", "PQ": "pg", "MM/HR": "mm/hr", "MM/H": "mm/hr", "ML/MIN": "mL/min", "ML/MIN/1.73M2": "mL/min/1.73m²", "%": "%", "RATIO": "ratio", "INDEX": "index",
}

# Lines that hold no result, by kind; none depends on case.
ADDRESS = (
    r"\bsector\b", r"\bfloor\b", r"\broad\b", r"\bstreet\b", r"\bbuilding\b", r"\bmetro suites\b", r"\bvaishali\b", r"\bghaziabad\b", r"\bnoida\b", r"\bnavi mumbai\b", r"\bturbhe\b", r"\bnew delhi\b", r"\bdelhi\b", r"\brohini\b", r"\bmidc\b", r"\bsuite\b", r"\bblock-e\b", r"\bpin-\b", r"\bzip-\b", r"\b\d{6}\b",
)
CONTACT = (
    r"\bphone\b", r"\btel\b", r"\bfax\b", r"\bmobile\b", r"\bcall us\b", r"\bcustomer care\b", r"\bwww\.", r"\bemail\b", r"\bwebsite\b", r"@thyrocare\b", r"@lalpathlabs\b", r"\b\d{10}\b", r"\b\d{4}[-\s]\d{3}[-\s]\d{3}\b", r"\b1800[-\s]\d{3}[-\s]\d{4}\b",
)
MAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
METADATA = (
    r"\breport status\b", r"\bcomplete report\b", r"\binterim report\b", r"\bprocessed at\b", r"\bcollected at\b", r"\breceived at\b", r"\breleased on\b", r"\bsample collected\b", r"\bsample received\b", r"\bcollected on\b", r"\breceived on\b", r"\bbarcode\b", r"\blabcode\b", r"\buhid\b", r"\bmr no\b", r"\bclient code\b", r"\bclient name\b", r"\bpatient info\b", r"\bvisit id\b", r"\bvisit no\b",
    r"\b[mf]\s*sex\s*:", r"\bsex\s*:\s*[mfo]\b", r"\bsex\s*:\s*\d+y", r"\bsex\s*:\s*$", r"\bgender\s*:", r"\bage\s*:\s*", r"\bname\s*:\s*", r"\bdate\s*:\s*", r"\breport\s*date\b", r"\bdate\s+of\s+report\b", r"\b(?:days\s+from\s+)?release\s+time\b", r"\breleased\s+on\b", r"\breceived\s+on\b", r"\bclient\s*code\b", r"\bclient\s*name\b", r"\bpatient\s*info\b", r"\bvisit\s*id\b", r"\bvisit\s*no\b", r"\bdatabase\b", r"\bdata\s*base\b", r"\bcustomer\s+details\b", r"\bcollected\s+on\b", r"\bcollected\s+at\b", r"\breceived\s+at\b", r"\bprocessed\s+at\b",
    r"\b(?:sct|srt|rrt)\b", r"\b\d+\s+(?:processing|cancelled|ready)\b", r"\(\d+\s*y\s*[/|]\s*[a-z]\)", r"\(\d+\s*y\b", r"\b\d{6,12}/[a-z0-9-]+\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:am|pm)?\b", r"\b\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}\b", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b", r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b", r"\b(?:serum|edta|plasma|urine|blood|whole\s+blood)\s*\|\s*[a-z0-9-]+\b", r"\b[a-z0-9-]+\s*\(\s*(?:serum|edta|plasma|urine|blood)\s*\)", r"\b[a-z]{2}\d{6,8}\b", r"\b[a-z]{3}\d{2,5}\b", r"\b(?:edta|serum|plasma|urine|blood)\s*:\s*[a-z]",
)
BOILERPLATE = (
    r"^y\s*our\b", r"\bscan qr code\b", r"\bauthenticity of reported results\b", r"\bpertain to the specimen\b", r"\bdependent on the quality\b", r"\bcorrelate with clinical conditions\b", r"\bexclusive jurisdiction\b", r"\bmedico legal purposes\b", r"\bcomputer generated medical\b", r"\bdisclaimer\b", r"\bcourt\b", r"\bjurisdiction\b", r"\bspecimen\b", r"\breference range\b", r"\btietz\s+nw\b", r"\bclinical\s+guide\s+to\s+laboratory\b", r"\bwb\s*saunders\b", r"\bphiladelphia\b", r"\bbenedict(?:’s|'s)?\s+method\b", r"\brothera(?:’s|'s)?\s+method\b", r"\bsulfur\s+granule\s+method\b", r"\bfouchet\s+method\b", r"\behhrlich\s+method\b", r"\bnitrite\s+by\s+nitrate\s+reduction\b", r"\bduring\s+interpretation\b", r"\bpoints\s+to\s+be\s+considered\b",
    r"\bkit validation reference\b", r"\bspecifications\s*:\b", r"\bintra assay\b", r"\binter assay\b", r"\bclinical significance\b", r"\bmentzer index\b", r"\bthalassemia trait\b", r"\bclinical correlation\b", r"\bclinical management\b", r"\bdiagnostics?\s*:\s*use and assessment\b", r"\bcurr opin endocrinol\b", r"\bbooks-verl\b", r"\bbooks-verlag\b", r"\bpublished\b", r"\bdiagnostic purpose\b", r"\bnormal range is indicative\b", r"\bconjunction with the patients\b", r"\bmedical history, clinical examination\b", r"\bdecreased? in vitamin d\b", r"\bincreased? in vitamin d\b", r"\bhelp the body absorb\b", r"\bcomplex corrinoid compound\b", r"\bnormal dna synthesis\b", r"\berythrocyte maturation\b", r"\bformation of myelin\b", r"\bneurological abnormalities\b", r"\bmacrocytic anemias\b", r"\bindicative of CAD risk\b", r"\bratio of Apo B to A1\b", r"\bplease correlate with clinical\b", r"\breport remarks\s*:\b", r"\b30 days from release time\b",
    r"\babove optimal\b", r"\bat risk\s*\(prediabetes\)", r"\bdiagnosing diabetes\b", r"\bextreme risk group\b", r"\b(?:low|moderate|high|very high)\s+risk\b", r"\bimpaired fasting glucose\b", r"\bkidney failure\b", r"\bpregnancy.*trimester\b", r"\bdiabetes\s*[\"']?e\b", r"\bcmia insufficient\b", r"\bhba\s*1c\s*\(ngsp\)\s*=", r"\bscoremonitarametersor\b", r"\bphealth\s+score\b", r"\btest parameters\b", r"\bborderline high\b", r"\bborder\s*line\s*high\b", r"\bdesirable\b", r"\boptimal\b", r"\bnear\s*optimal\b", r"\b(?:low|high|average)\s+(?:risk|limit)\b", r"\bout of range\b.*\bwithin range\b", r"\bborderline\b.*\bwithin range\b", r"\bwithin range\b", r"\bliver function\s+\d+\s+kidney function\b",
    r"^interpretation\b.*\bhba\s*1c\b", r"^interpretation\b.*\bdiabetes\b", r"\bas per american diabetes association\b", r"\bas per ada\b", r"^(?:normal|diabetes|pre-?diabetes|hypoglycaemia|hyperglycaemia)\b\s+[>=<]?\s*\d", r"\bblood glucose\s+and\s+hba\s*1c\b", r"\bascvd\b", r"\batherosclerotic cardiovascular\b", r"\bcoronary artery calcium\b", r"\b(?:1st|2nd|3rd)\s+trimester\b", r"\btrimester\b", r"\benzymatic\s*\[", r"\bnadh\b", r"\benzymatic\b", r"\bhelp diagnose a variety\b", r"\bdiagnosing anaemias\b", r"\bdetects the presence\b", r"\babnormal blood smear\b", r"\bnormal blood smear\b", r"\bidentifying infections\b", r"\bimmature white blood cells\b", r"\black of intrinsic factor\b", r"\bmalabsorption\b", r"\bfluid retention and changes in metabolism\b", r"\bimpaired kidney function\b", r"\bdiabetic ketoacidosis\b", r"\bvery high glucose levels\b", r"\bfasting plasma glucose\b",
    r"^very high\s*[-–]", r"^note\s+\d+\s*\.?\s+", r"\brs\.\s*\d+\b", r"^age\s+\d{1,3}$", r"\bwith symptoms of diabetes\b", r"\blow albumin\b.*\bliver disease\b", r"\bend organ damage\b", r"\bchd\s+stage\b", r"\bthe laboratory shall not be liable\b", r"\bnot be liable\b", r"₹\s*\d+",
)
METHODOLOGY = (
    r"^[a-z]{1,6}(?:/[a-z]{1,4})?\s*-\s+.+(?:method|derived|oxidase|esterase|peroxidase|colorimetric|end\s*point|measure|activation|guidelines|indirect|direct)\b", r"\bderived from serum\b", r"\blatex\s+enhanced\b", r"\bimmuno\s*turbidimetry\b", r"\bfully\s+automated\b", r"\belectrochemiluminescence\b", r"\bcompetitive\s+immunoassay\b", r"\bcompititive\s+immunoassay\b", r"\blatex\s+agglutination\b", r"\bbeckman\s+coulter\b", r"\bion\s+selective\s+electrode\b", r"\breference ranges as per\b", r"\bncep\b", r"\batp\s+iii\b", r"^\s*(?:[<>]?\s*\d+(?:\.\d+)?\s*[-–]?\s*)?(?:\d+(?:\.\d+)?)?\s*-\s*(?:Low|Average|High|Possibly due to)\b", r"^\s*(?:[<>]?=?\s*\d+(?:\.\d+)?|\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?)\s+(?:Desirable|Border\s*Line|High|Optimal|Low|Average|Moderate)\b", r"^(?:Low|High|Average|Desirable|Optimal)\s+(?:Low|High|Average|Desirable|Optimal)", r"^Dr\.?\s+[a-z][a-z]+(?:\s+[a-z][a-z]+)*\s*$", r"^tests\s+done\s*:", r"^test\s+asked\b", r"^hba\s+profile\b", r"^aarogyam\b", r"^[:;]+$",
)


def _by_letter(parts: list[str]) -> str:
    """Alternatives grouped by the letter that they begin with, so that most are passed over at once; none may depend on case."""
    groups: dict[str, list[str]] = {}
    rest = []
    for x in parts:
        if x[:1].isalpha() and x[1:2] not in ("?", "*", "+", "{"):
            groups.setdefault(x[0].lower(), []).append(x[1:])
        else:
            rest.append(x)
    return "|".join([*(f"{k}(?:{'|'.join(v)})" for k, v in groups.items()), *rest])


def alternation(bank: tuple[str, ...]) -> str:
    """One pattern for all of a bank, in which a word's or the line's beginning is looked for once and not by each."""
    of = lambda start: [x.removeprefix(start) for x in bank if x.startswith(start)]
    rest = [x for x in bank if not x.startswith(("\\b", "^"))]
    return "(?i)" + "|".join([*(f"{start}(?:{_by_letter(of(start))})" for start in ("\\b", "^") if of(start)), *rest])


NOISE = {kind: alternation(bank) for kind, bank in (("address", ADDRESS), ("contact", CONTACT), ("metadata", METADATA), ("boilerplate", BOILERPLATE), ("methodology", METHODOLOGY))}

# Words of an assay, of a table's head and of a panel, that are no name by themselves.
DESCRIPTORS = ("calculated", "calculation", "flow cytometry", "flowcytometry", "technology", "methodology", "immunoassay", "immunoturbidimetry", "turbidimetry", "nephelometry", "photometry", "colorimetry", "spectrophotometry", "chemiluminescence", "electrochemiluminescence", "elisa", "pcr", "hplc", "eclia", "e.c.l.i.a", "clia", "c.l.i.a", "h.p.l.c", "ise", "i.s.e", "ion selective electrode", "latex agglutination", "agglutination", "sls-hemoglobin method", "sld-hemoglobin method")
COLUMN_LABELS = ("test name", "testname", "value", "units", "unit", "flag", "result", "bio. ref. interval.", "bio. ref. interval", "reference range", "ref. interval")
PANELS = ("renal", "lipid", "liver", "thyroid", "cardiac", "diabetic", "anaemia", "anemia", "hematology", "haematology", "biochemistry", "electrolytes")
GENERIC_NAMES = ("calculated pq", "cph detection", "hf & ei", "hf & fc", "ratio", "%", ">", "<", "male:", "female:", "male :", "female :", "adults :", "adult :", "pq", "")
STATUS_WORDS = ("out of range", "borderline", "optimal", "desirable", "high", "low", "normal", "abnormal", "critical", "positive", "negative", "reactive", "monitor", "high concern", "physician review", "male", "female")
TECHNOLOGIES = ("IMMUNOTURBIDIMETRY", "PHOTOMETRY", "CALCULATED", "CALCULATION", "E.C.L.I.A", "ECLIA", "H.P.L.C", "HPLC", "I.S.E - INDIRECT", "I.S.E", "C.L.I.A", "CLIA", "CHEMILUMINESCENCE", "COLORIMETRY", "TURBIDIMETRY", "NEPHELOMETRY", "SPECTROPHOTOMETRY", "IMMUNOASSAY", "ELISA", "PCR")
TECHNOLOGY = "(?:" + "|".join(t.replace(".", r"\.") for t in TECHNOLOGIES) + ")"
GLUED_UNIT = r"(?:mg/dL|gm/dL|µg/dL|ng/dL|pg/dL|mcg/dL|g/dL|mg/mL|gm/mL|µg/mL|ng/mL|pg/mL|mcg/mL|µIU/mL|mIU/mL|IU/mL|U/mL|mIU/L|µIU/L|IU/L|U/L|mmol/L|µmol/L|nmol/L|pmol/L|mol/L|mEq/L|mg/L|gm/L|g/L|µg/L|ng/L|cells/cumm|cells/µL|cells/uL|million/cumm|lakhs/cumm|thousand/cumm|/cumm|/HPF|fL|pg|ng|µg|mg|kg|mg%|gm%|%|Ratio|Index)"

# How a line begins that holds no data, in lower case.
NO_DATA = (
    "method:", "methodology:", "note:", "barcode :", "barcode:", "barcode no", "labcode:", "labcode :", "uhid/mr no", "visit id", "client code", "client name", "disclaimer:", "specifications:", "kit validation reference", "clinical significance", "bio. ref. interval.", "precision %cv", "alert !!!", "*note", "deficiency :", "sufficiency :", "normal:", "ml/min/1.73", "and cellular health", "books-verl", "1.clinical management", "2.tietz", "rate . ann intern med", "thalassemia trait", "high sensitivity c-reactive protein", "m sex:", "m sex", "t&c apply", "bun / sr.creatinine ratio", "serum 2506", "2506", "labcode", "0 processing", "0 cancelled", "0 ready", "14 ready", "(22y", "(24y", "dy 357", "dy 359", "very high >", "very high 1", "high 200-", "high 1", "borderline high", "near optimal", "optimal <", "value units",
    "calculated", "flow cytometry", "sls-hemoglobin method", "cph detection", "hf & ei", "hf & fc", "hf &", "technology", "methodology", "lipid", "renal", "vitamins", "tietz", "books-verlag", "ann intern med", "clin chem", "j clin invest", "(reference :", "reference :", "conditions of reporting", "explanations", "suggestions", "customer details", "sample type | barcode", "sample_type /tests:", "barcodes/sample_type", "tests done :", "tests done:", "as declared in our data", "as per survey", "call us on", "or call us", "male:", "female:", "male :", "female :", "adult :", "adult male :", "adult female :", "adults :", "children :", "child :", "units ", "value ", "technology ", "methodology ", "out of range", "within range", "1.established", "1. three major", "1. age", "2. age", "liver function 100", "interpretation for hba", "interpretation for hb", "very high -", "very high –",
)
DISCLAIMERS = ("not a substitute", "consult your physician")
PROSE = r"(?i)\b(?:diabetes|mellitus|kidney|liver|disease|disorder|albumin|organ|damage|laboratory|liable|delay|performance|obligation|arising|connection|events)\b"
INTERPRETATIONS = (
    r"^(?:>=|<=|>|<)\s*\d+(?:\.\d+)?%\s*:", r"(?i:^As per\b)", r"^(?:VERY HIGH|BORDERLINE HIGH|NEAR OPTIMAL|OPTIMAL)\s+[<>]", r"^TOTAL CHOLESTEROL\s+[<>]", r"^[<>]\s*\d+\s*:", r"^(?:HIGH|LOW|NORMAL|OPTIMAL|DESIRABLE)\s+\d", r"^[<>]\d+[A-Z]", r"^\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?(?:\s+\S+)?\s*:", r"(?i:^EST\.\s+GLOMERULAR)", r"(?i:^VALUE\s+UNITS)", r"(?i:\d+[-–]\d+/HPF)",
    r"^(?:E\.C\.L\.I\.A|ECLIA|H\.P\.L\.C|HPLC|C\.L\.I\.A|CLIA|IMMUNOTURBIDIMETRY|PHOTOMETRY|CALCULATED|CALCULATION|CHEMILUMINESCENCE|COLORIMETRY|TURBIDIMETRY|NEPHELOMETRY|SPECTROPHOTOMETRY|IMMUNOASSAY|ELISA|PCR)\s+(?:ng|pg|µg|ug|μg|mcg|mg|gm|g|m?IU|m?U|mmol|µmol|umol|nmol|pmol|mol|mEq|fL|fl|%|cells|million|lakhs|thousand|/)",
    r"(?i:\d+\s+out of range\b)", r"(?i:\bwithin range\b)", r"(?i:\bascvd\b)", r"(?i:\b(?:1st|2nd|3rd)\s+trimester\b)", r"(?i:^(?:normal|diabetes|pre-?diabetes)\s+[0-9≥≤<>])", r"(?i:^very high\s*[-–])",
)
# A range and a label glued to it: both have to be found.
GLUED_RANGE = (r"^\d+[-–]\d+(?:[A-Z]|\s|$)", r"[A-Z]{3}")

# Footers of a text; the first lines of a laboratory's block; laboratories by name; edges of a page.
FOOTERS = r"(?i)\b(?:dr\.?|doctor)\s+[a-z]|\b(?:M\.?B\.?B\.?S|M\.?D|M\.?S|D\.?N\.?B|Ph\.?D|D\.?C\.?P|D\.?P\.?B)\b\.?|\bpathologist\b|\bmicrobiologist\b|\bbiochemist\b|\bconsultant\s+(?:pathologist|microbiologist|biochemist)\b|\bsignature\b|\b(?:verified|reported|signed|approved|authori[sz]ed)\s+by\b|\bscan\s+(?:the\s+)?qr\b|\bqr\s+code\b|\bbarcode\s*(?:label|sticker)\b|\bend\s+of\s+report\b|^\s*\*+\s*end\s*\*+\s*$|^\s*-+\s*end\s*-+\s*$"
BLOCK_KEYWORD = r"(?i)\b(?:THYROCARE|METROPOLIS|SRL|REDCLIFFE|HEALTHIANS|HEALTHCARE|DIAGNOSTICS?|LABORATOR(?:Y|IES)|PATHOLOGY|PATHLABS?|MEDICAL\s+LAB)\b"
LAB_KEYWORD = r"(?i)\b(?:Thyrocare|Redcliffe|Diagnostics?|Laboratories|Laboratory|Pathology|Pathlab|Healthcare|Labs?)\b"
STUB_LAB = r"(?i)\b(?:Diagnostics?|Laboratories|Laboratory|Pathology|Pathlab|Healthcare|Lab|Thyrocare)\b"
PAGE_HEADERS = r"(?i)^processed\s+at\s*:|^thyrocare\b|^nabl\b|^report\s+status\s*:|^report\s+availability"
PAGE_FOOTERS = r"(?i)^page\s+\d+\s+of\s+\d+|^\d+\s+of\s+\d+$|^-\s*\d+\s*-$|^printed\s+on\b|^this\s+report\s+is\s+not\s+valid|^not\s+a\s+substitute\b|^consult\s+your\s+physician|^www\.|^https?://|^\(\d{3}\)|^[+]\d{1,3}\s*[-\s]\d"

# Rows of a page: what begins a block of its own, what looks like a result, and the heads of columns.
TITLE = r"^[A-Z][A-Z0-9 (),\-/&]{1,60}$"
TITLE_UNIT = r"(?i)\b(?:g/dL|mg/dL|mmol/L|µmol/L|umol/L|nmol/L|ng/mL|pg/mL|µg/mL|ug/mL|IU/L|U/L|mIU/L|%|cells|million|lakh|thousand|fL|fl|g/L|mmHg|ratio|mEq/L)\b"
BLOCK_BOILERPLATE = r"(?i)^conditions\s+of\s+reporting|^customer\s+details|^tests?\s+done\s*:|^barcodes?\s*[:/]|^sample\s+type|^reference\s*:|^disclaimer\s*:|^note\s*:|^as\s+declared\s+in|^as\s+per\s+survey|^call\s+us\s+on|^clinical\s+significance|^bio\.\s*ref\.\s*interval|^method\s*:|^methodology\s*:|^test\s+name\b|^test\s*name\s+(?:technology|value|units|result|reference|range|low|high)|^(?:sr\.?\s*no\.?|s\.?\s*no\.?)\s+test\s+name|^investigation\s+result|^parameter\s+(?:result|value|units|reference)|^analyte\s+(?:result|value|units|reference)"
LAB_ROW = r"(?i)\d+(?:\.\d+)?\s*(?:g/dL|mg/dL|mmol|µmol|umol|nmol|ng|pg|IU|U/L|mIU|%|fL|fl|cells|lakh|million|mEq|mmHg)|[<>]\s*\d|\d+\s*[-–]\s*\d+"
BLOCK_METADATA = r"(?i)^(?:name|patient|ref\.?\s*by|date|sample|age|gender|sex)\s*:"
COLUMN_HEAD = r"(?i)\b(?:test\s*name|technology|bio\.\s*ref|reference\s+interval|result\s+value|result\s+unit)\b"
COLUMN_HEADS = r"(?i)^(?:(?:test\s*name|technology|value|units|result|reference\s+interval|bio\.?\s*ref\.?\s*interval|low|high|flag|s\.?\s*no\.?|sr\.?\s*no\.?|investigation|parameter|analyte)\s+)+"
