"""Fixed values of the detectors: patterns, labels, word lists, priorities.

Results depend on these exactly.  Patterns are Python's; Java ones for
built-in functions are in ``columns``.
"""

from __future__ import annotations

import re

# ---- fixed values: file kinds --------------------------------------------------
TEXT_SUFFIXES = {".txt", ".md", ".markdown", ".html", ".htm", ".json", ".xml", ".yml", ".yaml", ".log"}
CSV_SUFFIXES = {".csv", ".tsv"}
DOCX_SUFFIXES = {".docx"}
XLSX_SUFFIXES = {".xlsx", ".xlsm", ".xltx", ".xltm"}
PDF_SUFFIXES = {".pdf"}
IMAGE_SUFFIXES = {".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"}

# ---- fixed values: delimiters and elements -----------------------------------
PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">", "“": "”", "‘": "’", "«": "»", '"': '"', "'": "'", "`": "`"}
SAME_QUOTES = frozenset("\"'`")
APOSTROPHES = frozenset("'\"`‘")
CLOSERS = frozenset(PAIRS.values()) - SAME_QUOTES
DELIMITERS = frozenset(PAIRS) | CLOSERS
HTML_ELEMENTS = frozenset(
    """a abbr article aside b body br button caption code col div em figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hr html i img input label li link main meta nav ol option p pre script section select small span strong
    style table tbody td tfoot th thead title tr u ul""".split()
)
EDGE = " \t,;:.\"'“”«»`()[]{}"

# ---- fixed values: kinds ---------------------------------------------------------
PRIORITY = {"email": 120, "id_or_ruc": 115, "phone": 100, "account": 95, "address": 90, "organization": 85, "date": 80, "location": 78, "person": 75, "possible_person": 70, "value": 60}
OTHER_PRIORITY = 50
EXACT_PRIORITY, FUZZY_PRIORITY = 1000, 850
PREFIX = {"email": "EMAIL", "phone": "PHONE", "id_or_ruc": "ID", "organization": "COMPANY", "person": "PERSON", "possible_person": "PERSON", "address": "ADDRESS", "account": "ACCOUNT", "date": "DATE"}
SPACED_KINDS = frozenset(("email", "organization", "person", "possible_person", "address"))
PREFIXES = "PERSON|COMPANY|EMAIL|PHONE|ID|ADDRESS|ACCOUNT|DATE|LOCATION|VALUE"
PLACEHOLDER = re.compile(rf"(?:{PREFIXES})-\d+(?:@(?:example\.(?:com|org|net)|demo\.local|local))?", re.I)
PLACEHOLDER_LABEL = re.compile(rf"(?:{PREFIXES})-", re.I)
SAFE_DOMAINS = (".local", "example.com", "example.org", "example.net")
SAFE_LITERALS = frozenset(("tel-0000", "id-0000", "persona demo", "empresa demo", "demo company", "person demo", "company demo"))
NER_LABELS = {"PERSON": "person", "PER": "person", "ORG": "organization", "COMPANY": "organization", "LOC": "location", "GPE": "location", "LOCATION": "location"}

# ---- fixed values: numbers, addresses of persons and mail -------------------------
WORD = re.compile(r"[^\W_]+")
EMAIL = re.compile(r"(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}(?![\w.-])", re.I)
PHONE = re.compile(
    r"(?<![\w-])(?:\(\s*\+?[0-9]{1,3}\s*\)\s*|\+[0-9]{1,3}[\s.-]|507[\s.-])?"
    r"(?:\(?[0-9]{3}\)?[\s.-][0-9]{4}|\(?[0-9]{4}\)?[\s.-][0-9]{4}|\(?[0-9]{3}\)?[\s.-][0-9]{3}[\s.-][0-9]{4}|[0-9]{8})(?![\w-])"
)
IDENTIFIER = re.compile(r"(?<!\w)(?<!\d[,./-])[0-9]{1,3}(?:[-/.\s][0-9]{1,8}){1,5}(?!\w|[-/.]\d)")
CURRENCY_BEFORE = re.compile(r"(?:B/\.?|\$|US\$|USD|EUR|€|£)\s*$", re.I)
DATE = re.compile(r"(?<!\w)(?:[0-3]?\d[/-][01]?\d[/-](?:\d{2}|\d{4})|\d{4}[/-][01]?\d[/-][0-3]?\d)(?!\w)")
DATE_WORDS = re.compile(r"nacimiento|birth|dob|fecha\s+de\s+nac|born|fecha|date")
ACCOUNT = re.compile(
    r"\b(?:cuenta(?:\s+bancaria)?|account|iban|swift|bank\s+account|n[úu]mero\s+de\s+cuenta)\b\s*(?:n[úu]m(?:ero)?\.?\s*)?(?:[:#=-]\s*)?"
    r"(?P<value>[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}|[A-Z0-9]{8,11}|[0-9][0-9 -]{6,24}[0-9])",
    re.I,
)

# ---- fixed values: labelled fields -------------------------------------------------
LABELS = (
    r"(?:empresa|compa[ñn][íi]a|sociedad|corporaci[óo]n|proveedor|cliente|company|organization|organizaci[óo]n|vendor|supplier|bank|banco"
    r"|direcci[óo]n|domicilio|address|residencia|residence|ubicaci[óo]n|lugar|localizaci[óo]n|location|city|ciudad|country|pa[íi]s"
    r"|tel[eé]fono|telephone|phone|tel\.?|id|identificador|ruc|pasaporte|passport|tax\s+id|document(?:o|\s+number)?\s*id"
    r"|cuenta|n[úu]mero\s+de\s+cuenta|account|iban|swift|fecha|date|nacimiento|birth|nombre|name|representante|representative|apoderado|attorney|valor|value|dato|data)"
)
VALUE_END = rf"(?=\s*(?:[,;\[\]\(\)\{{\}}<>«»“”]|{LABELS}\s*[:=#-])|$)"


def _labelled(labels: str, least: int, most: int) -> re.Pattern[str]:
    return re.compile(rf"(?<!\w)(?P<label>{labels})\s*[:=-]\s*(?P<value>[^\n\]\)\}}»”>\[]{{{least},{most}}}?){VALUE_END}", re.I)


COMPANY_FIELD = _labelled(r"empresa|compa[ñn][íi]a|sociedad|corporaci[óo]n|proveedor|cliente|company|organization|vendor|supplier|bank|banco", 2, 90)
LOCATION_FIELD = _labelled(r"ubicaci[óo]n|lugar|localizaci[óo]n|location|city|ciudad|country|pa[íi]s", 2, 80)
ADDRESS_FIELD = _labelled(r"direcci[óo]n|domicilio|address|residencia|residence", 2, 100)
VALUE_FIELD = _labelled(r"valor|value|dato|data", 1, 80)
IDENTIFIER_FIELD = re.compile(r"(?<!\w)(?:id|identificador|ruc|pasaporte|passport|tax\s+id|document(?:o|\s+number)?\s*id)\s*[:#=-]\s*(?P<value>[A-Z0-9][A-Z0-9._\-/]{2,32})", re.I)
CORPORATE = re.compile(r"s\.?\s*a\.?|s\.?\s*a\.?s\.?|ltd|llc|inc|corp|empresa|compa[ñn][íi]a|sociedad|organizaci[óo]n|organization|banco|bank", re.I)
COMPANY_MARKERS = ("compañía", "compania", "empresa", "sociedad", "corporación", "organización", "company", "organization")
_PART = r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9#][A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9#'./-]*"
STREET = re.compile(
    r"(?<!\w)(?:calle|c\.?|avenida|av\.?|carrera|cra\.?|v[íi]a|boulevard|blvd\.?|street|st\.?|road|rd\.?|avenue|ave\.?)\s+"
    rf"{_PART}(?:[ \t]+(?!{LABELS}\s*[:=#-]){_PART}){{0,10}}(?![A-Za-z0-9_.+-]*@)",
    re.I,
)
# A company suffix, and what may stand in the words before it.
SUFFIX_TEXT = r"(?:S\.?[ \t]+A\.?|S\.A\.?|SAS|L\.?T\.?D\.?|L\.L\.C\.?|I\.?N\.?C\.?|C\.?O\.?R\.?P\.?|GmbH)(?!\w)"
COMPANY_START = re.compile(r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]", re.I)
COMPANY_PART = re.compile(r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9&.'’-]", re.I)
COMPANY_WORDS = 6

# ---- fixed values: names of persons ----------------------------------------------
NAME_TOKEN = re.compile(r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ'’\-]{1,30}")
NAME_JOINT = re.compile(r"[ \t]+|[ \t]*[-/]\s*")
NOT_NAMES = frozenset(n.casefold() for n in ("Demo Company", "Empresa Demo", "Persona Demo", "Estados Financieros", "Estado De", "Notas A", "República De", "Ciudad De", "Panamá", "Total Activos", "Total Pasivos"))
GENERIC_WORDS = frozenset(
    """a an and company confidential document ejemplo example financieros general heading interna internal legal nota note
    normal sample text texto the total variant uppercase lowercase bold italic underlined table list valor value dato data
    location city ciudad country país""".split()
)
NAME_LABELS = frozenset("cliente client contact contacto customer name nombre person persona representative representante apoderado attorney".split())
NOT_PERSON_WORDS = frozenset(
    """account address avenida bancaria bank calle city ciudad company compañía cuenta dirección domicilio empresa id iban
    location organización organization pasaporte passport phone ruc teléfono telephone ubicación valor value dato data""".split()
)
IDENTIFIER_LABELS = frozenset("id identificador ruc pasaporte passport tax documento document".split())
LABEL_WORD = re.compile(r"[a-záéíóúüñ]+", re.I)
LOOK_BACK = 48

# ---- fixed values: tables -----------------------------------------------------------
CELL_LABELS = {
    "address": "address", "account": "account", "bank account": "account", "city": "location", "cliente": "organization", "client": "organization", "company": "organization",
    "contact": "person", "contacto": "person", "country": "location", "cuenta": "account", "dirección": "address", "domicilio": "address", "email": "email", "empresa": "organization",
    "id": "id_or_ruc", "location": "location", "nombre": "person", "name": "person", "phone": "phone", "proveedor": "organization", "provider": "organization", "ruc": "id_or_ruc",
    "supplier": "organization", "tel": "phone", "teléfono": "phone", "telephone": "phone", "ubicación": "location",
}
CELL_TITLES = {"address": "Dirección", "account": "Cuenta", "email": "Email", "id_or_ruc": "ID", "location": "Ubicación", "organization": "Empresa", "person": "Nombre", "phone": "Teléfono"}

# ---- fixed values: limits -------------------------------------------------------------
FUZZY_THRESHOLD, FUZZY_LEAST = 0.88, 5
MOST_SUGGESTIONS, SHOWN_SUGGESTIONS, NAMED_RULES = 80, 20, 5
DOCUMENT_LABEL = "DOCUMENT-001"
