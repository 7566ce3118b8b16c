"""Answers judged against a golden set: case rows and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.predicates import clamp_score, strip

# Every field is read as text first, so that 4, 4.0 and "4" are all a score.
VERDICT_SCHEMA = T.StructType(
    [
        T.StructField("correcta", T.StringType()),
        T.StructField("cita_correcta", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("justificacion", T.StringType()),
    ]
)

NO_ANSWER = "sin respuesta"
BAD_VERDICT = "veredicto no valido"


def with_defaults(cases: DataFrame, position: str = "pos") -> DataFrame:
    """Fill the optional fields of golden cases; ``position`` counts from 0."""
    number = (F.col(position) + 1).cast("string")
    return cases.withColumns(
        {
            "id": F.coalesce("id", F.concat(F.lit("caso_"), number)),
            **{
                c: F.coalesce(c, F.lit(""))
                for c in ("categoria", "fuente_esperada", "tool_esperada")
            },
        }
    )


def judge_input(question: Column, expected: Column, source: Column, answer: Column) -> Column:
    """The text a judge model is given. Its parts are fixed values."""
    return F.concat(
        F.lit("PREGUNTA:\n"), question,
        F.lit("\n\nRESPUESTA ESPERADA (pauta de correccion):\n"), expected,
        F.lit("\n\nFUENTE ESPERADA (documento o tabla que deberia citarse): "), source,
        F.lit("\n\nRESPUESTA DEL AGENTE (a evaluar):\n"), answer,
        F.lit("\n\nEmite tu veredicto."),
    )


def read_verdict(text: Column) -> Column:
    return F.from_json(text, VERDICT_SCHEMA)


def checked_verdict(raw: Column) -> Column:
    """Struct (correcta, cita_correcta, score, justificacion) from what
    :func:`read_verdict` gave; null when a field is missing or of no use."""
    number = raw["score"].try_cast("double")
    verdict = F.struct(
        raw["correcta"].try_cast("boolean").alias("correcta"),
        raw["cita_correcta"].try_cast("boolean").alias("cita_correcta"),
        F.when(number == F.floor(number), clamp_score(number)).alias("score"),
        raw["justificacion"].alias("justificacion"),
    )
    whole = F.lit(True)
    for field in VERDICT_SCHEMA.names:
        whole = whole & verdict[field].isNotNull()
    return F.when(whole, verdict)


def used_tools(trace: Column) -> Column:
    return F.coalesce(F.transform(trace, lambda call: call["name"]), F.array().cast("array<string>"))


def case_results(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per case. ``answers`` is ``(id, answer, trace, verdict, error)``;
    a case that failed, has no answer or no valid verdict becomes an error row."""
    # The JSON is read in a step of its own, once per row.
    found = answers.withColumn("raw", read_verdict(F.col("verdict"))).select(
        "id",
        F.lit(True).alias("answered"),
        "answer",
        used_tools(F.col("trace")).alias("tools"),
        checked_verdict(F.col("raw")).alias("v"),
        F.col("error").alias("failure"),
    )
    error = (
        F.when(F.col("answered").isNull(), F.lit(NO_ANSWER))
        .when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("v").isNull(), F.lit(BAD_VERDICT))
    )
    rows = cases.join(found, "id", "left").withColumn("error", error)
    ok = F.col("error").isNull()

    def when_ok(value: Column, otherwise: Column) -> Column:
        return F.when(ok, value).otherwise(otherwise)

    no = F.lit(False)
    return rows.select(
        "id",
        "categoria",
        "pregunta",
        "fuente_esperada",
        "tool_esperada",
        when_ok(F.col("answer"), F.lit("")).alias("respuesta_agente"),
        when_ok(F.col("tools"), F.array().cast("array<string>")).alias("tools_usadas"),
        when_ok(F.array_contains("tools", F.col("tool_esperada")), no).alias("tool_correcta"),
        when_ok(F.col("v.correcta"), no).alias("correcta"),
        when_ok(F.col("v.cita_correcta"), no).alias("cita_correcta"),
        when_ok(F.col("v.score"), F.lit(1)).alias("score"),
        when_ok(F.col("v.justificacion"), F.lit("")).alias("justificacion"),
        "error",
    )


def _share(hit: str) -> Column:
    ok = F.col("error").isNull()
    return F.lit(100.0) * F.count_if(ok & F.col(hit)) / F.count_if(ok)


def _mean_score() -> Column:
    ok = F.col("error").isNull()
    return F.sum(F.when(ok, F.col("score"))).cast("double") / F.count_if(ok)


def global_metrics(results: DataFrame) -> DataFrame:
    """One row: counts, three percentages, mean score, whether any case failed."""
    metrics = {
        "respuesta_correcta_pct": _share("correcta"),
        "cita_correcta_pct": _share("cita_correcta"),
        "tool_correcta_pct": _share("tool_correcta"),
        "score_promedio": _mean_score(),
    }
    ok = F.count_if(F.col("error").isNull())
    return results.agg(
        F.count(F.lit(1)).alias("n"),
        ok.alias("n_ok"),
        *[F.when(ok > 0, m).otherwise(F.lit(0.0)).alias(name) for name, m in metrics.items()],
        F.coalesce(F.max(F.col("error").isNotNull()), F.lit(False)).alias("hubo_errores"),
    )


def category_metrics(results: DataFrame) -> DataFrame:
    """One row per category; metrics are null where every case failed."""
    ok = F.count_if(F.col("error").isNull())
    return results.groupBy("categoria").agg(
        ok.alias("n"),
        F.when(ok > 0, _share("correcta")).alias("correctas_pct"),
        F.when(ok > 0, _share("cita_correcta")).alias("citas_ok_pct"),
        F.when(ok > 0, _mean_score()).alias("score_promedio"),
    )


def _mark(hit: str) -> Column:
    return F.when(F.col(hit), F.lit("OK")).otherwise(F.lit("X"))


def case_details(results: DataFrame) -> DataFrame:
    """Printable per-case columns."""
    return results.select(
        "id",
        "categoria",
        "pregunta",
        _mark("correcta").alias("correcta"),
        _mark("cita_correcta").alias("cita"),
        _mark("tool_correcta").alias("tool"),
        F.concat(F.col("score").cast("string"), F.lit("/5")).alias("score"),
        "fuente_esperada",
        "tool_esperada",
        F.when(F.size("tools_usadas") > 0, F.array_join("tools_usadas", ", "))
        .otherwise(F.lit("ninguna"))
        .alias("tools_usadas"),
        "justificacion",
        strip(F.col("respuesta_agente")).alias("respuesta_agente"),
        "error",
    )


def tool_check(runs: DataFrame, tools: str = "tools_usadas", expected: str = "tool_esperada") -> DataFrame:
    """Add ``resultado``: 'ok', 'sin_tool' (none used) or 'otra_tool'."""
    return runs.withColumn(
        "resultado",
        F.when(F.size(tools) == 0, F.lit("sin_tool"))
        .when(F.array_contains(tools, F.col(expected)), F.lit("ok"))
        .otherwise(F.lit("otra_tool")),
    )


def report_lines(results: DataFrame) -> DataFrame:
    """``(section, item, line)``: the report as Markdown, to be written in this
    order with ``df.write.text``; nothing of it passes through the driver."""

    def pct(c: str, digits: int) -> Column:
        return F.format_string(f"%.{digits}f%%", F.bround(c, digits))

    def two(c: str) -> Column:
        return F.format_string("%.2f", F.bround(c, 2))

    # The lines of the report.
    top = global_metrics(results).select(
        F.lit(0).alias("section"),
        F.lit("").alias("item"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("- **Casos evaluados:** "), F.col("n_ok"), F.lit("/"), F.col("n")),
            F.lit("\n## Metricas globales\n\n| Metrica | Valor |\n|---|---|"),
            F.concat(F.lit("| Respuesta correcta | "), pct("respuesta_correcta_pct", 1), F.lit(" |")),
            F.concat(F.lit("| Cita correcta | "), pct("cita_correcta_pct", 1), F.lit(" |")),
            F.concat(F.lit("| Tool correcta (deterministico) | "), pct("tool_correcta_pct", 1), F.lit(" |")),
            F.concat(F.lit("| Score promedio (1-5) | "), two("score_promedio"), F.lit(" |")),
            F.lit("\n## Por categoria\n\n| Categoria | N | Correctas | Citas OK | Score prom |\n|---|---|---|---|---|"),
        ).alias("line"),
    )
    dash = F.lit("-")
    by_category = category_metrics(results).select(
        F.lit(1).alias("section"),
        F.col("categoria").alias("item"),
        F.concat(
            F.lit("| "), "categoria", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "),
            F.coalesce(F.when(F.col("n") > 0, pct("correctas_pct", 0)), dash), F.lit(" | "),
            F.coalesce(F.when(F.col("n") > 0, pct("citas_ok_pct", 0)), dash), F.lit(" | "),
            F.coalesce(F.when(F.col("n") > 0, two("score_promedio")), dash), F.lit(" |"),
        ).alias("line"),
    )
    d = case_details(results)
    ok_lines = F.concat(
        F.lit("- Correcta: **"), "correcta", F.lit("** | Cita: **"), "cita", F.lit("** | Score: **"),
        "score", F.lit("**\n- Fuente esperada: `"), "fuente_esperada", F.lit("` | Tool esperada: `"),
        "tool_esperada", F.lit("` | Tools usadas: `"), "tools_usadas", F.lit("` ("), "tool",
        F.lit(")\n- Juez: "), "justificacion",
        F.lit("\n\n<details><summary>Respuesta del agente</summary>\n\n```\n"), "respuesta_agente",
        F.lit("\n```\n</details>\n"),
    )
    cases = d.select(
        F.lit(2).alias("section"),
        F.col("id").alias("item"),
        F.concat(
            F.lit("### "), "id", F.lit(" — "), "categoria", F.lit("\n**Pregunta:** "), "pregunta", F.lit("\n\n"),
            F.when(
                F.col("error").isNotNull(),
                F.concat(F.lit("> ERROR al evaluar este caso: "), "error", F.lit("\n")),
            ).otherwise(ok_lines),
        ).alias("line"),
    )
    return top.unionByName(by_category).unionByName(cases)
