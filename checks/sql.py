"""The SQL each registered query is checked against.

Fixed values: the word lists, tokens, patterns and texts in it are those of
``tamiz.functions.fixed`` and of the report, which results depend on."""

from __future__ import annotations

from .queries import CATALOG, ORDER

# --- derived tables, as in checks.derived ---------------------------------------

DIRTY = """SELECT event_id,
  CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'No Aplica' WHEN 2 THEN ' n/a ' WHEN 3 THEN 'Desconocido'
    WHEN 4 THEN '' ELSE event_type END AS estado,
  CASE WHEN event_id % 10 <> 9 THEN strftime(ts, '%Y-%m-%d') END AS fecha_evento,
  CASE WHEN event_id % 2 = 0 THEN replace(CAST(value AS VARCHAR), '.', ',') ELSE CAST(value AS VARCHAR) END AS monto,
  CAST(user_id AS VARCHAR) AS usuario,
  CASE event_id % 3 WHEN 0 THEN 'Si' WHEN 1 THEN 'no' ELSE 'verdadero ' END AS activo,
  CAST(NULL AS VARCHAR) AS vacia,
  CASE WHEN event_id % 10 = 0 THEN value END AS casi_vacia,
  CASE WHEN event_id % 5 < 2 THEN user_id END AS mitad,
  'fijo' AS constante,
  '+569 ' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS contacto,
  'AB-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS clave,
  '12.' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') || '.678-K' AS documento,
  'u' || user_id || '@example.com' AS medio,
  props AS codigo_servicio,
  ts AS fecha_hora
FROM events"""

_N, _F, _T, _D = "numeric_int", "numeric_float", None, "date"
# Column, physical type, type settled by it.
COLUMNS = {
    "region": [("r_regionkey", "int", _N), ("r_name", "string", _T)],
    "nation": [("n_nationkey", "int", _N), ("n_name", "string", _T), ("n_regionkey", "int", _N)],
    "customer": [("c_custkey", "bigint", _N), ("c_name", "string", _T), ("c_nationkey", "int", _N),
                 ("c_acctbal", "double", _F), ("c_mktsegment", "string", _T)],
    "supplier": [("s_suppkey", "bigint", _N), ("s_name", "string", _T), ("s_nationkey", "int", _N),
                 ("s_acctbal", "double", _F)],
    "part": [("p_partkey", "bigint", _N), ("p_name", "string", _T), ("p_brand", "string", _T),
             ("p_type", "string", _T), ("p_size", "int", _N), ("p_retailprice", "double", _F)],
    "orders": [("o_orderkey", "bigint", _N), ("o_custkey", "bigint", _N), ("o_orderstatus", "string", _T),
               ("o_totalprice", "double", _F), ("o_orderdate", "timestamp_ntz", _D),
               ("o_orderpriority", "string", _T)],
    "lineitem": [("l_orderkey", "bigint", _N), ("l_partkey", "bigint", _N), ("l_suppkey", "bigint", _N),
                 ("l_linenumber", "int", _N), ("l_quantity", "double", _F), ("l_extendedprice", "double", _F),
                 ("l_discount", "double", _F), ("l_tax", "double", _F), ("l_returnflag", "string", _T),
                 ("l_linestatus", "string", _T), ("l_shipdate", "timestamp_ntz", _D)],
    "documents": [("doc_id", "bigint", _N), ("text", "string", _T), ("lang", "string", _T),
                  ("source", "string", _T), ("n_chars", "bigint", _N)],
    "pages": [("page_id", "bigint", _N), ("url", "string", _T), ("html", "string", _T)],
    "conversations": [("conv_id", "bigint", _N), ("turn", "bigint", _N), ("role", "string", _T),
                      ("text", "string", _T)],
    "dirty_events": [("event_id", "bigint", _N), ("estado", "string", _T), ("fecha_evento", "string", _T),
                     ("monto", "string", _T), ("usuario", "string", _T), ("activo", "string", _T),
                     ("vacia", "string", _T), ("casi_vacia", "double", _F), ("mitad", "bigint", _N),
                     ("constante", "string", _T), ("contacto", "string", _T), ("clave", "string", _T),
                     ("documento", "string", _T), ("medio", "string", _T), ("codigo_servicio", "string", _T),
                     ("fecha_hora", "timestamp_ntz", _D)],
}

# --- predicates -----------------------------------------------------------------

SPACES = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(v: str) -> str:
    return f"regexp_replace({v}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def semantic(v: str) -> str:
    return (
        f"{strip(f'lower({v})')} IN ('no aplica','no_aplica','noapl','n/a','na','null','none','sin dato',"
        "'sin información','no disponible','nd','s/d','desconocido','no informado','')"
    )


def matches(v: str, pattern: str) -> str:
    return f"regexp_matches({strip(v)}, '{pattern}')"


def numeric(v: str) -> str:
    d = "[0-9]+(?:_[0-9]+)*"
    replaced = f"replace({v}, ',', '.')"
    return matches(
        replaced,
        rf"(?i)^[+-]?(?:(?:{d}\.?(?:{d})?|\.{d})(?:e[+-]?{d})?|inf(?:inity)?|nan)$",
    )


def decimal_mark(v: str) -> str:
    return f"regexp_matches({v}, '[.,]')"


def date_text(v: str) -> str:
    return matches(v, r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$")


def boolean(v: str) -> str:
    return f"{strip(f'lower({v})')} IN ('true','false','si','no','yes','1','0','verdadero','falso')"


def rut(v: str) -> str:
    return matches(v, r"^\d{1,2}\.?\d{3}\.?\d{3}-[\dkK]$")


def email(v: str) -> str:
    return matches(v, r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$")


def phone(v: str) -> str:
    return matches(v, r"^[+(]?[\d\s()\-]{7,20}$")


def date_like(v: str) -> str:
    return matches(v, r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{2,4}$")


def pct(part: str, whole: str, digits: int = 2) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN round_even(CAST({part} AS DOUBLE) / {whole} * 100, {digits}) ELSE 0.0::DOUBLE END"
    )


PII_WORDS = {
    "rut": ["rut", "run"],
    "email": ["email", "correo", "mail"],
    "telefono": ["telefono", "fono", "phone", "celular", "movil"],
    "nombre": ["nombre", "name", "apellido", "lastname"],
    "fecha_nacimiento": ["nacimiento", "birthday", "birth", "fecha_nac"],
    "salario": ["salario", "sueldo", "remuneracion", "salary", "wage"],
    "direccion": ["direccion", "domicilio", "address"],
}


def pii_name(name: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower({name}), '{'|'.join(words)}') THEN '{kind}'" for kind, words in PII_WORDS.items()
    )
    return f"CASE {whens} END"


# --- profiles -------------------------------------------------------------------


def relation(name: str) -> str:
    return f"({DIRTY})" if name == "dirty_events" else name


def profile_ctes(name: str, all_values: bool = False) -> str:
    """CTEs ending in ``cols``: one row per column of the table."""
    order = ", ".join(ORDER[name])
    cells = "\nUNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS name, '{t}' AS dt, {f"'{b}'" if b else 'NULL::VARCHAR'} AS built, "
        f"{str(t == 'string').lower()} AS is_text, CAST({c} AS VARCHAR) AS v, ord FROM base"
        for i, (c, t, b) in enumerate(COLUMNS[name])
    )
    limit = "" if all_values else "WHERE rn <= 50"
    pii = "TRUE" if all_values else "rn <= 20"
    return f"""
base AS (SELECT *, row_number() OVER (ORDER BY {order}) AS ord FROM {relation(name)}),
cells AS ({cells}),
counts AS (
  SELECT pos, name, dt, built, is_text, count(*) AS n_rows, count(v) AS present,
    count(*) FILTER (WHERE is_text AND {semantic('v')}) AS semantic, count(DISTINCT v) AS uniq
  FROM cells GROUP BY ALL),
firsts AS (SELECT pos, v, row_number() OVER (PARTITION BY pos ORDER BY ord) AS rn FROM cells WHERE v IS NOT NULL),
rates AS (
  SELECT pos, avg(CAST({date_text('v')} AS INT)) AS dr, avg(CAST({numeric('v')} AS INT)) AS nr,
    avg(CAST({boolean('v')} AS INT)) AS br, bool_or({decimal_mark('v')}) AS dec, stddev_samp(length(v)) AS sd,
    avg(CAST({rut('v')} AS INT)) FILTER (WHERE {pii}) AS rr, avg(CAST({email('v')} AS INT)) FILTER (WHERE {pii}) AS er,
    avg(CAST({phone('v')} AS INT)) FILTER (WHERE {pii} AND NOT {date_like('v')}) AS pr
  FROM firsts {limit} GROUP BY pos),
shown AS (SELECT pos, string_agg(v, '|' ORDER BY rn) AS vals, min(v) FILTER (WHERE rn = 1) AS one
  FROM firsts WHERE rn <= 5 GROUP BY pos),
typed AS (
  SELECT c.*, r.*  EXCLUDE (pos), coalesce(s.vals, '') AS vals, s.one,
    {pct('n_rows - present', 'n_rows')} AS null_pct, {pct('semantic', 'n_rows')} AS sem_pct,
    {pct('uniq', 'n_rows')} AS unique_pct,
    CASE WHEN present = 0 THEN 'empty' WHEN built IS NOT NULL THEN built
      WHEN regexp_matches(lower(name), 'fecha|date|fec_|_fec|dt_|_dt|nacimiento|ingreso|cierre|inicio') AND dr >= 0.7
        THEN 'date'
      WHEN nr >= 0.8 THEN CASE WHEN dec THEN 'numeric_float' ELSE 'numeric_int' END
      WHEN br >= 0.9 THEN 'boolean'
      WHEN uniq <= 20 OR uniq / present < 0.05 THEN 'categorical'
      WHEN uniq / present > 0.95 AND coalesce(sd < 3, FALSE) THEN 'identifier'
      ELSE 'text' END AS kind,
    coalesce({pii_name('name')}, CASE WHEN rr >= 0.5 THEN 'rut' WHEN er >= 0.5 THEN 'email' WHEN pr >= 0.5 THEN 'telefono' END) AS pii
  FROM counts c LEFT JOIN rates r USING (pos) LEFT JOIN shown s USING (pos)),
cols AS (
  SELECT *, list_filter([
    CASE WHEN null_pct = 100 THEN 'columna_100pct_vacia'
      WHEN null_pct >= 80 THEN 'alta_tasa_nulos_' || CAST(round_even(null_pct, 0) AS BIGINT) || 'pct'
      WHEN null_pct >= 50 THEN 'mayoria_nulos_' || CAST(round_even(null_pct, 0) AS BIGINT) || 'pct' END,
    CASE WHEN sem_pct > 0 AND null_pct + sem_pct > null_pct + 5
      THEN 'nulos_semanticos_' || CAST(round_even(sem_pct, 0) AS BIGINT) || 'pct' END,
    CASE WHEN unique_pct = 100 AND n_rows > 10 THEN 'todos_valores_unicos' END,
    CASE WHEN uniq = 1 THEN 'un_solo_valor_unico=' || CASE WHEN is_text THEN '''' || one || '''' ELSE one END END,
    CASE WHEN kind = 'date' AND is_text THEN 'fecha_guardada_como_string' END,
    CASE WHEN kind IN ('numeric_int', 'numeric_float') AND is_text THEN 'numerico_guardado_como_string' END
  ], lambda f: f IS NOT NULL) AS flags,
  '{name}' AS table_name
  FROM typed)"""


def profile_sql(name: str, all_values: bool = False) -> str:
    return f"""WITH {profile_ctes(name, all_values)}
SELECT table_name, pos AS col_pos, name, dt AS dtype_physical, kind AS dtype_inferred, n_rows,
  n_rows - present AS null_count, null_pct, semantic AS semantic_null_count, sem_pct AS semantic_null_pct,
  round_even(least(null_pct + sem_pct, 100.0::DOUBLE), 2) AS effective_null_pct, uniq AS unique_count, unique_pct,
  vals AS sample_values, pii IS NOT NULL AS pii_flag, pii AS pii_type, array_to_string(flags, ';') AS quality_flags
FROM cols"""


def _table_row(name: str) -> str:
    cols = ", ".join(c for c, _, _ in COLUMNS[name])
    return f"""(WITH {profile_ctes(name)},
d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {relation(name)})) AS dups
  FROM {relation(name)}),
a AS (SELECT max(n_rows) AS n_rows, count(*) AS n_cols, sum(n_rows - present) AS nulls,
    count(*) FILTER (WHERE present < n_rows) AS con_nulos, count(*) FILTER (WHERE semantic > 0) AS con_sem,
    count(pii) AS n_pii, count(*) FILTER (WHERE list_contains(flags, 'fecha_guardada_como_string')) AS fechas,
    count(*) FILTER (WHERE list_contains(flags, 'columna_100pct_vacia')) AS vacias,
    count(*) FILTER (WHERE len(flags) >= 2) AS multi,
    list(name ORDER BY pos) FILTER (WHERE pii IS NOT NULL) AS pii_list,
    list({{'nombre': name, 'tipo_inferido': kind, 'nulos_pct': null_pct,
      'nulos_efectivos_pct': round_even(least(null_pct + sem_pct, 100.0::DOUBLE), 2), 'pii': pii,
      'flags_calidad': flags}} ORDER BY pos) AS columnas
  FROM cols),
g AS (SELECT *, {pct('nulls', '(n_rows * n_cols)', 1)} AS gp FROM a, d)
SELECT '{name}' AS table_name, 'parquet' AS source, '{name}' AS path_or_table, n_rows, CAST(n_cols AS INT) AS n_cols,
  dups AS row_duplicate_count, {pct('dups', 'n_rows')} AS row_duplicate_pct,
  coalesce(pii_list, []::VARCHAR[]) AS pii_columns,
  list_filter([CASE WHEN gp >= 30 THEN 'alta_tasa_nulos_global_' || gp || 'pct' END,
    CASE WHEN dups > 0 THEN 'filas_duplicadas_' || dups END,
    CASE WHEN multi > 0 THEN 'columnas_con_multiples_problemas=' || multi END], lambda f: f IS NOT NULL) AS quality_flags,
  {{'filas': n_rows, 'columnas': CAST(n_cols AS INT), 'duplicados_filas': dups, 'nulos_pct_global': gp,
    'columnas_con_nulos': con_nulos, 'columnas_con_nulos_semanticos': con_sem, 'columnas_pii': n_pii,
    'fechas_como_string': fechas, 'columnas_vacias': vacias}} AS summary, columnas FROM g)"""


TABLE_PROFILES = f"""SELECT table_name, source, path_or_table, n_rows, n_cols, row_duplicate_count, row_duplicate_pct,
  array_to_string(pii_columns, ';') AS pii_columns, array_to_string(quality_flags, ';') AS quality_flags,
  unnest(summary)
FROM ({' UNION ALL '.join(f"SELECT * EXCLUDE (columnas) FROM {_table_row(n)}" for n in CATALOG)})"""

PROFILE_DIGEST = f"""SELECT table_name, CAST(to_json({{'table_name': table_name, 'source': source,
  'shape': {{'filas': n_rows, 'columnas': n_cols}}, 'filas_duplicadas': row_duplicate_count,
  'columnas_pii': pii_columns, 'flags_calidad_tabla': quality_flags, 'resumen': summary, 'columnas': columnas}})
  AS VARCHAR) AS digest
FROM {_table_row('dirty_events')}"""

_TEXT_COLUMNS = [c for c, t, _ in COLUMNS["dirty_events"] if t == "string"]
_PREDICATES = {
    "semantic_nulls": semantic, "numeric": numeric, "decimal_mark": decimal_mark, "dates": date_text,
    "booleans": boolean, "ruts": rut, "emails": email, "phones": phone, "date_like": date_like,
    "not_digits": lambda v: f"NOT regexp_matches(translate({v}, '.-', ''), '^[0-9]+$')",
}
VALUE_PREDICATES = f"""SELECT name, count(v) AS present,
  {', '.join(f"count(*) FILTER (WHERE {p('v')}) AS {n}" for n, p in _PREDICATES.items())}
FROM ({' UNION ALL '.join(f"SELECT '{c}' AS name, {c} AS v FROM ({DIRTY})" for c in _TEXT_COLUMNS)})
WHERE v IS NOT NULL GROUP BY name"""

# --- CSV, load facts, exploration -------------------------------------------------

_NA = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', "
    "'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)


def _csv_kind(i: int, c: str) -> str:
    return f"""SELECT CAST({i} AS INT) AS col_pos, '{c}' AS name, CASE WHEN count(v) = 0 THEN 'float64'
  WHEN bool_and(regexp_matches(v, '^\\s*[+-]?[0-9]+\\s*$') AND TRY_CAST(trim(v) AS BIGINT) IS NOT NULL) FILTER (WHERE v IS NOT NULL)
    THEN CASE WHEN count(v) = count(*) THEN 'int64' ELSE 'Int64' END
  WHEN bool_and(regexp_matches(v, '(?i)^\\s*[+-]?(?:(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?)\\s*$'))
    THEN 'float64'
  WHEN bool_and(v IN ('True','TRUE','true','False','FALSE','false'))
    THEN CASE WHEN count(v) = count(*) THEN 'bool' ELSE 'boolean' END
  ELSE 'object' END AS kind
FROM (SELECT CASE WHEN CAST({c} AS VARCHAR) NOT IN {_NA} THEN CAST({c} AS VARCHAR) END AS v FROM ({DIRTY}))"""


CSV_KINDS = " UNION ALL ".join(_csv_kind(i, c) for i, (c, _, _) in enumerate(COLUMNS["dirty_events"]))

_DIRTY_NAMES = [c for c, _, _ in COLUMNS["dirty_events"]]
_PRESENT = " + ".join(f"count({c})" for c in _DIRTY_NAMES)
_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS n, count(*) - count({c}) AS nulls, "
    + (f"count(*) FILTER (WHERE {c} = 'No Aplica')" if t == "string" else "0")
    + f" AS no_aplica FROM ({DIRTY})"
    for c, t, _ in COLUMNS["dirty_events"]
)

LOAD_METADATA = f"""SELECT max(n) AS n_rows, CAST(count(*) AS INT) AS n_cols, CAST(sum(n) AS BIGINT) AS total_cells,
  {pct('sum(nulls)', 'sum(n)')} AS null_pct_global,
  coalesce(string_agg(name, ';') FILTER (WHERE nulls = n), '') AS columns_all_null FROM ({_NULLS})"""

SEPARATOR_VOTES = """WITH lines AS (
  SELECT doc_id, unnest(list_slice(string_split(text, chr(10)), 1, 20)) AS line FROM documents),
seps AS (SELECT * FROM (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')) t(pos, sep)),
c AS (SELECT doc_id, pos, sep, length(line) - length(replace(line, sep, '')) AS n FROM lines, seps
  WHERE """ + strip("line") + """ <> ''),
g AS (SELECT doc_id, pos, sep, n, count(*) AS k FROM c GROUP BY ALL),
m AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY k DESC, n) = 1),
b AS (SELECT doc_id, sep FROM m WHERE n > 0
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (n + 1) * k DESC, pos) = 1)
SELECT d.doc_id, coalesce(b.sep, ',') AS separator FROM documents d LEFT JOIN b USING (doc_id)"""

NULL_TABLE = f"""SELECT name, nulls, {pct('nulls', 'n', 1)} AS pct,
  repeat('#', CAST(floor({pct('nulls', 'n', 1)} / 5) AS INT)) AS bar FROM ({_NULLS}) WHERE nulls > 0"""

DATE_COLUMNS = f"""WITH d AS ({DIRTY})
SELECT 'fecha_evento' AS name, 'string' AS dtype,
  (SELECT fecha_evento FROM d WHERE fecha_evento IS NOT NULL ORDER BY event_id LIMIT 1) AS example
UNION ALL SELECT 'fecha_hora', 'timestamp_ntz', (SELECT CAST(fecha_hora AS VARCHAR) FROM d ORDER BY event_id LIMIT 1)"""

NO_APLICA = f"""SELECT name, no_aplica AS n, {pct('no_aplica', 'n', 1)} AS pct FROM ({_NULLS}) WHERE no_aplica > 0"""

EXECUTIVE_SUMMARY = f"""SELECT max(n) AS filas, CAST(count(*) AS INT) AS columnas, CAST(sum(nulls) AS BIGINT) AS celdas_nulas,
  CAST(sum(n) AS BIGINT) AS celdas, {pct('sum(nulls)', 'sum(n)', 1)} AS nulos_pct,
  CAST(count(*) FILTER (WHERE {pct('nulls', 'n', 1)} > 50) AS INT) AS columnas_mas_50pct_nulas,
  CAST(count(*) FILTER (WHERE contains(name, 'fecha') OR contains(name, 'date')) AS INT) AS columnas_fecha,
  CAST(count(*) FILTER (WHERE no_aplica > 0) AS INT) AS columnas_no_aplica FROM ({_NULLS})"""

# --- chunks -------------------------------------------------------------------------


def chunks(size: int, step: int, docs: str = "documents") -> str:
    """``(doc_name, chunk_id, text, char_start, char_end)``, offsets from the
    joined words before the chunk."""
    return f"""SELECT doc_name, CAST(i AS INT) AS chunk_id, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS text,
    CAST(CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(w[1 : i * {step}], ' ')) + 1 END AS INT) AS char_start,
    CAST(CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(w[1 : i * {step}], ' ')) + 1 END
      + length(array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ')) AS INT) AS char_end
  FROM (SELECT doc_name, w, unnest(range(0, CAST(ceil(len(w) / {step}) AS BIGINT))) AS i
    FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_name, regexp_split_to_array({strip('text')}, '{SPACES}+') AS w
      FROM {docs} WHERE {strip('text')} <> ''))"""


_CHUNKS = chunks(300, 250)
_LABELLED = chunks(300, 250, "(SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")

# --- retrieval ----------------------------------------------------------------------

_KNN = """q AS (SELECT label AS query_id, list(x ORDER BY i) AS qv FROM (
    SELECT label, i, avg(x) AS x FROM (
      SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
    GROUP BY label, i) GROUP BY label),
s AS (SELECT query_id, 'label_' || label AS doc_name, CAST(vec_id AS INT) AS chunk_id,
    round_even(list_cosine_similarity(qv, embedding::DOUBLE[]), 12) AS sim FROM q, embeddings),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_name, chunk_id) AS INT) AS rank,
    round_even(sim, 4) AS score FROM s)"""


def knn(k: int, condition: str) -> str:
    return f"WITH {_KNN} SELECT query_id, rank, doc_name, chunk_id, score FROM r WHERE rank <= {k} AND {condition}"


KNN_APPROX_RECALL = """WITH s AS (
  SELECT a.vec_id AS q, round_even(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS sim
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT q, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC) AS rank FROM s)
SELECT count(DISTINCT q) AS queries, count(*) AS hits, TRUE AS found FROM r WHERE rank <= 10 AND sim >= 0.3"""


_HITS = f"""{_KNN},
h AS (SELECT r.*, d.text FROM r JOIN documents d ON d.doc_id = r.chunk_id WHERE rank <= 3 AND sim >= 0.4)"""

# --- evaluation -----------------------------------------------------------------------

_CASES = """SELECT CAST(doc_id AS VARCHAR) AS id, lang AS categoria, 'pregunta ' || doc_id AS pregunta,
  'respuesta de ' || source AS respuesta_esperada, source AS fuente_esperada,
  CASE WHEN doc_id % 2 = 0 THEN 'search_governance' ELSE 'profile_table' END AS tool_esperada FROM documents"""

# What a verdict must parse to is worked out from the label, not from its JSON.
_RESULTS = f"""SELECT c.id, categoria, pregunta, fuente_esperada, tool_esperada,
  CASE WHEN ok THEN ' respuesta ' || l.doc_id || chr(10) ELSE '' END AS respuesta_agente,
  CASE WHEN ok THEN tools ELSE []::VARCHAR[] END AS tools_usadas,
  ok AND list_contains(tools, tool_esperada) AS tool_correcta,
  ok AND quality = 1 AS correcta, ok AND toxic = 0 AS cita_correcta,
  CAST(CASE WHEN ok THEN greatest(1, least(5, quality * 9 - 2 + l.doc_id % 4)) ELSE 1 END AS INT) AS score,
  CASE WHEN ok THEN 'caso ' || l.doc_id ELSE '' END AS justificacion,
  CASE WHEN l.doc_id IS NULL THEN 'sin respuesta' WHEN l.doc_id % 11 = 0 THEN 'cuota agotada'
    WHEN l.doc_id % 7 IN (0, 1) THEN 'veredicto no valido' END AS error
FROM ({_CASES}) c LEFT JOIN (
  SELECT *, CASE doc_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['search_governance']
    ELSE ['profile_table', 'list_catalog'] END AS tools FROM labels) l ON c.id = CAST(l.doc_id AS VARCHAR),
  LATERAL (SELECT coalesce(l.doc_id % 11 <> 0 AND l.doc_id % 7 NOT IN (0, 1), FALSE) AS ok)"""


def share(hit: str) -> str:
    return f"100.0::DOUBLE * count(*) FILTER (WHERE error IS NULL AND {hit}) / count(*) FILTER (WHERE error IS NULL)"


_MEAN = "CAST(sum(score) FILTER (WHERE error IS NULL) AS DOUBLE) / count(*) FILTER (WHERE error IS NULL)"
_GLOBAL = f"""SELECT count(*) AS n, count(*) FILTER (WHERE error IS NULL) AS n_ok,
  {share('correcta')} AS respuesta_correcta_pct, {share('cita_correcta')} AS cita_correcta_pct,
  {share('tool_correcta')} AS tool_correcta_pct, {_MEAN} AS score_promedio, bool_or(error IS NOT NULL) AS hubo_errores
FROM ({_RESULTS})"""


def _category(sel: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE error IS NULL) > 0 THEN {sel} END"


_BY_CATEGORY = f"""SELECT categoria, count(*) FILTER (WHERE error IS NULL) AS n,
  {_category(share('correcta'))} AS correctas_pct, {_category(share('cita_correcta'))} AS citas_ok_pct,
  {_category(_MEAN)} AS score_promedio FROM ({_RESULTS}) GROUP BY categoria"""


def _mark(c: str) -> str:
    return f"CASE WHEN {c} THEN 'OK' ELSE 'X' END"


_DETAILS = f"""SELECT id, categoria, pregunta, {_mark('correcta')} AS correcta, {_mark('cita_correcta')} AS cita,
  {_mark('tool_correcta')} AS tool, score || '/5' AS score, fuente_esperada, tool_esperada,
  CASE WHEN len(tools_usadas) > 0 THEN array_to_string(tools_usadas, ', ') ELSE 'ninguna' END AS tools_usadas,
  justificacion, {strip('respuesta_agente')} AS respuesta_agente, error FROM ({_RESULTS})"""


def _fmt(c: str, digits: int, suffix: str = "") -> str:
    return f"printf('%.{digits}f', round_even({c}, {digits})) || '{suffix}'"


EVAL_REPORT = f"""SELECT CAST(0 AS INT) AS section, '' AS item,
  '- **Casos evaluados:** ' || n_ok || '/' || n || chr(10) || chr(10) || '## Metricas globales' || chr(10) || chr(10)
  || '| Metrica | Valor |' || chr(10) || '|---|---|' || chr(10)
  || '| Respuesta correcta | ' || {_fmt('respuesta_correcta_pct', 1, '%')} || ' |' || chr(10)
  || '| Cita correcta | ' || {_fmt('cita_correcta_pct', 1, '%')} || ' |' || chr(10)
  || '| Tool correcta (deterministico) | ' || {_fmt('tool_correcta_pct', 1, '%')} || ' |' || chr(10)
  || '| Score promedio (1-5) | ' || {_fmt('score_promedio', 2)} || ' |' || chr(10) || chr(10)
  || '## Por categoria' || chr(10) || chr(10) || '| Categoria | N | Correctas | Citas OK | Score prom |' || chr(10)
  || '|---|---|---|---|---|' AS line FROM ({_GLOBAL})
UNION ALL SELECT 1, categoria, '| ' || categoria || ' | ' || n || ' | '
  || coalesce({_fmt('correctas_pct', 0, '%')}, '-') || ' | ' || coalesce({_fmt('citas_ok_pct', 0, '%')}, '-') || ' | '
  || coalesce({_fmt('score_promedio', 2)}, '-') || ' |' FROM ({_BY_CATEGORY})
UNION ALL SELECT 2, id, '### ' || id || ' — ' || categoria || chr(10) || '**Pregunta:** ' || pregunta || chr(10) || chr(10)
  || CASE WHEN error IS NOT NULL THEN '> ERROR al evaluar este caso: ' || error || chr(10)
  ELSE '- Correcta: **' || correcta || '** | Cita: **' || cita || '** | Score: **' || score || '**' || chr(10)
    || '- Fuente esperada: `' || fuente_esperada || '` | Tool esperada: `' || tool_esperada || '` | Tools usadas: `'
    || tools_usadas || '` (' || tool || ')' || chr(10) || '- Juez: ' || justificacion || chr(10) || chr(10)
    || '<details><summary>Respuesta del agente</summary>' || chr(10) || chr(10) || '```' || chr(10)
    || respuesta_agente || chr(10) || '```' || chr(10) || '</details>' || chr(10) END FROM ({_DETAILS})"""

# --- rate limits ------------------------------------------------------------------------

_LOG = "SELECT user_id AS client, epoch_us(ts) AS t, event_id FROM events"

THROTTLE_ATTEMPTS = f"""SELECT client, t, event_id, count(*) OVER (PARTITION BY client ORDER BY t
  RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS attempts FROM ({_LOG})"""

# One step per event of a client; its hits are the admitted times so far.
THROTTLE_ADMITTED = f"""WITH RECURSIVE log AS (
  SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, event_id) AS i FROM ({_LOG})),
fold AS (
  SELECT client, t, event_id, i, TRUE AS admitted, [t] AS hits FROM log WHERE i = 1
  UNION ALL
  SELECT l.client, l.t, l.event_id, l.i,
    len(list_filter(f.hits, lambda h: l.t - h < 86400000000)) < 3,
    CASE WHEN len(list_filter(f.hits, lambda h: l.t - h < 86400000000)) < 3
      THEN list_append(list_filter(f.hits, lambda h: l.t - h < 86400000000), l.t)
      ELSE list_filter(f.hits, lambda h: l.t - h < 86400000000) END
  FROM fold f JOIN log l ON l.client = f.client AND l.i = f.i + 1)
SELECT client, t, event_id, admitted FROM fold"""

# Events with event_id % 50 = 0 arrive in the last of three parts.
THROTTLE_LATE = f"""WITH RECURSIVE parts AS (
  SELECT *, CASE WHEN event_id % 50 = 0 THEN 2
    ELSE (t - min(t) OVER ()) * 3 // (max(t) OVER () - min(t) OVER () + 1) END AS arrival FROM ({_LOG})),
newest AS (
  SELECT client, arrival, max(max(t)) OVER (PARTITION BY client ORDER BY arrival
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM parts GROUP BY client, arrival),
flagged AS (SELECT p.*, coalesce(p.t < n.newest, FALSE) AS late FROM parts p JOIN newest n USING (client, arrival)),
log AS (
  SELECT *, row_number() OVER (PARTITION BY client ORDER BY arrival, t, event_id) AS i FROM flagged WHERE NOT late),
fold AS (
  SELECT client, t, event_id, i, TRUE AS admitted, [t] AS hits FROM log WHERE i = 1
  UNION ALL
  SELECT l.client, l.t, l.event_id, l.i,
    len(list_filter(f.hits, lambda h: l.t - h < 86400000000)) < 3,
    CASE WHEN len(list_filter(f.hits, lambda h: l.t - h < 86400000000)) < 3
      THEN list_append(list_filter(f.hits, lambda h: l.t - h < 86400000000), l.t)
      ELSE list_filter(f.hits, lambda h: l.t - h < 86400000000) END
  FROM fold f JOIN log l ON l.client = f.client AND l.i = f.i + 1)
SELECT client, t, event_id, admitted, FALSE AS late FROM fold
UNION ALL SELECT client, t, event_id, FALSE, TRUE FROM flagged WHERE late"""

THROTTLE_STREAM_CAP = f"""SELECT client, t, event_id,
  row_number() OVER (PARTITION BY t // 86400000000 ORDER BY t, event_id) <= 100 AS admitted
FROM ({THROTTLE_ADMITTED}) WHERE admitted"""

THROTTLE_STREAM_CAPPED = f"""SELECT client, t, event_id, admitted AS within_limit, admitted AND
  count(*) FILTER (admitted) OVER (PARTITION BY t // 86400000000 ORDER BY t, event_id) <= 100 AS admitted
FROM ({THROTTLE_ADMITTED})"""

# One step per event of the whole log; hits are (client, time) pairs.
THROTTLE_DAILY_CAP = f"""WITH RECURSIVE log AS (
  SELECT *, row_number() OVER (ORDER BY t, event_id) AS i, t // 86400000000 AS day FROM ({_LOG})),
fold AS (
  SELECT client, t, event_id, i, day, 1 AS used, TRUE AS admitted, [{{'c': client, 't': t}}] AS hits FROM log WHERE i = 1
  UNION ALL
  SELECT client, t, event_id, i, day, CASE WHEN adm THEN used + 1 ELSE used END, adm,
    CASE WHEN adm THEN list_append(recent, {{'c': client, 't': t}}) ELSE recent END
  FROM (
    SELECT l.client, l.t, l.event_id, l.i, l.day, CASE WHEN l.day = f.day THEN f.used ELSE 0 END AS used,
      list_filter(f.hits, lambda h: l.t - h.t < 21600000000) AS recent,
      (CASE WHEN l.day = f.day THEN f.used ELSE 0 END) < 100
        AND len(list_filter(f.hits, lambda h: h.c = l.client AND l.t - h.t < 21600000000)) < 1 AS adm
    FROM fold f JOIN log l ON l.i = f.i + 1))
SELECT client, t, event_id, admitted FROM fold"""

ORACLE = {
    **{
        f"profile_{n}": profile_sql(n)
        for n in ("orders", "customer", "lineitem", "documents", "pages", "conversations", "dirty_events")
    },
    "profile_incremental": f"""SELECT name, n_rows, null_count, null_pct, semantic_null_count, semantic_null_pct,
  effective_null_pct, dtype_inferred, pii_flag, pii_type, TRUE AS unique_near, TRUE AS read_once
FROM ({profile_sql("dirty_events", all_values=True)})""",
    "profile_dirty_events_all_values": profile_sql("dirty_events", all_values=True),
    "table_profiles": TABLE_PROFILES,
    "profile_digest": PROFILE_DIGEST,
    "duplicate_rows_documents": """SELECT count(*) AS n_rows,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_rows FROM documents""",
    "duplicate_rows_lineitem": """SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (
      SELECT DISTINCT l_partkey, l_quantity, l_discount, l_returnflag FROM lineitem)) AS duplicate_rows FROM lineitem""",
    "value_predicates": VALUE_PREDICATES,
    "client_ips": f"""SELECT coalesce({strip("string_split(nullif(xff, ''), ',')[1]")}, host, 'unknown') AS ip, count(*) AS n
      FROM (SELECT CASE event_id % 4 WHEN 0 THEN ' 10.0.0.' || (user_id % 250) || ' , 172.16.0.1' WHEN 1 THEN '' END AS xff,
        CASE WHEN event_id % 8 <> 3 THEN '192.168.0.' || (user_id % 250) END AS host FROM events) GROUP BY 1""",
    "csv_kinds": CSV_KINDS,
    "csv_round_trip": """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
      FROM customer""",
    "load_metadata": LOAD_METADATA,
    "separator_votes": SEPARATOR_VOTES,
    "null_table": NULL_TABLE,
    "date_columns": DATE_COLUMNS,
    "no_aplica_counts": NO_APLICA,
    "mixed_column_examples": "SELECT event_id, props AS codigo_servicio FROM events ORDER BY event_id LIMIT 5",
    "non_numeric_amounts": f"""SELECT count(monto) AS present, count(*) FILTER (WHERE NOT
      regexp_matches(translate(monto, '.-', ''), '^[0-9]+$')) AS non_numeric FROM ({DIRTY})""",
    "missing_half": f"""SELECT count(*) - count(mitad) AS missing, {pct('count(*) - count(mitad)', 'count(*)', 1)} AS pct
      FROM ({DIRTY})""",
    "executive_summary": EXECUTIVE_SUMMARY,
    "chunk_documents": _CHUNKS,
    "chunk_small_windows": f"SELECT * EXCLUDE (text), md5(text) AS text_md5 FROM ({chunks(40, 25)})",
    "chunks_per_document": f"SELECT doc_name, count(*) AS n_chunks FROM ({_CHUNKS}) GROUP BY doc_name",
    "indexed_documents": f"SELECT DISTINCT doc_name FROM ({_CHUNKS})",
    "chunks_to_insert": f"""SELECT doc_name, chunk_id, char_start, char_end FROM ({_CHUNKS})
      WHERE (doc_name, chunk_id) NOT IN (SELECT doc_name, chunk_id FROM ({_LABELLED}))""",
    "upserted_index": f"""WITH a AS (SELECT (SELECT count(*) FROM ({_LABELLED})) AS l, (SELECT count(*) FROM ({_CHUNKS})) AS n)
      SELECT 'replace' AS step, l AS n FROM a UNION ALL SELECT 'insert', n - l FROM a
      UNION ALL SELECT 'again', 0 FROM a UNION ALL SELECT 'count', n FROM a""",
    "vector_pairing": """SELECT count(*) FILTER (WHERE doc_id IS NOT NULL AND vec_id IS NOT NULL) AS paired,
      count(*) FILTER (WHERE vec_id IS NULL) AS only_left, count(*) FILTER (WHERE doc_id IS NULL) AS only_right
      FROM documents FULL JOIN embeddings ON doc_id = vec_id""",
    "knn_label_means": knn(5, "sim >= 0.3"),
    "csv_mixed_headers": "SELECT * REPLACE (CASE WHEN c_custkey % 3 <> 2 THEN c_acctbal END AS c_acctbal, c_nationkey::BIGINT AS c_nationkey) FROM customer",
    "csv_skiprows": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders",
    "csv_multiline": "SELECT doc_id, nullif(text, '') AS text FROM documents",
    "knn_index_all_cells": knn(5, "sim >= 0.3"),
    "knn_approx_recall": KNN_APPROX_RECALL,
    "knn_min_score": knn(20, "sim >= 0.25"),
    "knn_min_score_rounded": knn(20, "score >= 0.25"),
    "context_blocks": f"""WITH {_HITS}
      SELECT q.query_id, coalesce(string_agg('[FUENTE ' || rank || '] Documento: ' || doc_name || ' | Fragmento #' || chunk_id
        || ' | Relevancia: ' || {_fmt('score', 2)} || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10)
        ORDER BY rank), 'No se encontraron fragmentos relevantes en el corpus de gobernanza.') AS context
      FROM q LEFT JOIN h USING (query_id) GROUP BY q.query_id""",
    "search_results": f"""WITH {_HITS}
      SELECT q.query_id, CAST(count(rank) AS INT) AS n_resultados, coalesce(CAST(to_json(list({{'documento': doc_name,
        'fragmento_id': chunk_id, 'relevancia': score, 'texto': text}} ORDER BY rank) FILTER (WHERE rank IS NOT NULL))
        AS VARCHAR), '[]') AS fragmentos
      FROM q LEFT JOIN h USING (query_id) GROUP BY q.query_id""",
    "retrieval_check": f"""WITH {_KNN}
      SELECT q.query_id, 'label_' || q.query_id AS expected_doc, min(rank) AS position, min(rank) IS NOT NULL AS passed
      FROM q LEFT JOIN (SELECT * FROM r WHERE rank <= 5 AND sim >= 0.3) h
        ON h.query_id = q.query_id AND h.doc_name = 'label_' || q.query_id GROUP BY q.query_id""",
    "eval_cases": f"SELECT * REPLACE (array_to_string(tools_usadas, ',') AS tools_usadas) FROM ({_RESULTS})",
    "eval_global": _GLOBAL,
    "eval_by_category": _BY_CATEGORY,
    "eval_details": _DETAILS,
    "eval_report": EVAL_REPORT,
    "judge_inputs": f"""SELECT id, 'PREGUNTA:' || chr(10) || pregunta || chr(10) || chr(10)
      || 'RESPUESTA ESPERADA (pauta de correccion):' || chr(10) || respuesta_esperada || chr(10) || chr(10)
      || 'FUENTE ESPERADA (documento o tabla que deberia citarse): ' || fuente_esperada || chr(10) || chr(10)
      || 'RESPUESTA DEL AGENTE (a evaluar):' || chr(10) || ' respuesta ' || doc_id || chr(10) || chr(10) || chr(10)
      || 'Emite tu veredicto.' AS judge_input
      FROM ({_CASES}) c JOIN labels ON id = CAST(doc_id AS VARCHAR)""",
    "agent_tool_check": f"""SELECT tool_esperada, CASE WHEN doc_id % 3 = 0 THEN 'sin_tool'
        WHEN tool_esperada = CASE doc_id % 3 WHEN 1 THEN 'search_governance' ELSE 'profile_table' END THEN 'ok'
        ELSE 'otra_tool' END AS resultado, count(*) AS n
      FROM ({_CASES}) c JOIN labels ON id = CAST(doc_id AS VARCHAR) GROUP BY ALL""",
    "throttle_attempts": THROTTLE_ATTEMPTS,
    "throttle_admitted": THROTTLE_ADMITTED,
    "throttle_daily_cap": THROTTLE_DAILY_CAP,
    "throttle_stream": THROTTLE_ADMITTED,
    "throttle_stream_late": THROTTLE_LATE,
    "throttle_stream_daily_cap": THROTTLE_STREAM_CAP,
    "throttle_stream_capped": THROTTLE_STREAM_CAPPED,
    "throttle_stream_state": f"SELECT DISTINCT client FROM ({_LOG}) WHERE client % 2 = 1",
}
