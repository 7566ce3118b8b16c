"""Word lists, patterns and formats that results depend on."""

# Lower-cased, stripped texts that stand for "no data".
SEMANTIC_NULLS = [
    "no aplica", "no_aplica", "noapl", "n/a", "na", "null", "none",
    "sin dato", "sin información", "no disponible", "nd", "s/d",
    "desconocido", "no informado", "", " ",
]

# Texts read as booleans.
BOOLEAN_WORDS = ["true", "false", "si", "no", "yes", "1", "0", "verdadero", "falso"]

# Column-name fragments that hint at a date.
DATE_NAME_PATTERN = r"fecha|date|fec_|_fec|dt_|_dt|nacimiento|ingreso|cierre|inicio"

# Value patterns (ASCII digits).
DATE_TEXT_PATTERN = r"^\d{1,4}[-/\.]\d{1,2}[-/\.]\d{1,4}$"
DATE_LIKE_PATTERN = r"^\d{1,4}[-/\.]\d{1,2}[-/\.]\d{2,4}$"
RUT_PATTERN = r"^\d{1,2}\.?\d{3}\.?\d{3}-[\dkK]$"
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^[\+\(]?[\d\s\(\)\-]{7,20}$"

# The texts a float parser takes once ',' is '.' and blanks are stripped:
# digit groups may be joined by '_', and inf / infinity / nan count.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
NUMERIC_PATTERN = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf(?:inity)?|nan)$"
)

# Column-name keywords and the kind of personal data they
# announce; the first keyword found in this order decides.
PII_NAME_KEYWORDS = [
    ("rut", "rut"),
    ("run", "rut"),
    ("email", "email"),
    ("correo", "email"),
    ("mail", "email"),
    ("telefono", "telefono"),
    ("fono", "telefono"),
    ("phone", "telefono"),
    ("celular", "telefono"),
    ("movil", "telefono"),
    ("nombre", "nombre"),
    ("name", "nombre"),
    ("apellido", "nombre"),
    ("lastname", "nombre"),
    ("nacimiento", "fecha_nacimiento"),
    ("birthday", "fecha_nacimiento"),
    ("birth", "fecha_nacimiento"),
    ("fecha_nac", "fecha_nacimiento"),
    ("salario", "salario"),
    ("sueldo", "salario"),
    ("remuneracion", "salario"),
    ("salary", "salario"),
    ("wage", "salario"),
    ("direccion", "direccion"),
    ("domicilio", "direccion"),
    ("address", "direccion"),
]

# CSV cells that mean "missing" (the default list of pandas).
CSV_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# CSV detection.
CSV_SEPARATORS = [",", ";", "\t", "|"]
CSV_SNIFF_BYTES = 4096
CSV_SNIFF_LINES = 20

# Sizes of the value samples.
TYPE_SAMPLE = 50
PII_SAMPLE = 20
SHOWN_SAMPLE = 5

# Texts of the retrieval context.
CONTEXT_SEPARATOR = "\n\n---\n\n"
CONTEXT_EMPTY = "No se encontraron fragmentos relevantes en el corpus de gobernanza."

# Whitespace as Python's str.strip()/str.split() see it.
WHITESPACE = (
    "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
# At most 16 characters between leading and trailing whitespace.
SHORT_CORE = r"(?Us)^[\s\x1c-\x1f]*+.{0,16}?[\s\x1c-\x1f]*+$"
