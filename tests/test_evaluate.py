import json

from pyspark.sql import functions as F

from tamiz.operators import evaluate as ev
from tamiz.sources.files import read_corpus, read_golden_set

CASE = "id string, categoria string, pregunta string, respuesta_esperada string, fuente_esperada string, tool_esperada string"
ANSWER = "id string, answer string, trace array<struct<name:string,args:string,ok:boolean>>, verdict string, error string"


def verdict(**changes):
    return json.dumps({"correcta": True, "cita_correcta": False, "score": 4, "justificacion": "j", **changes})


def parsed(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    return [r[0] and tuple(r[0]) for r in df.select(ev.checked_verdict(ev.read_verdict(F.col("t")))).collect()]


def test_parse_verdict(spark):
    assert parsed(
        spark, verdict(), verdict(score=9), verdict(score=-2), verdict(score="3"), verdict(score=4.0),
        verdict(score=4.5), verdict(score=None), "{", "", None, '{"correcta": true}', verdict(correcta="quizas"),
    ) == [
        (True, False, 4, "j"), (True, False, 5, "j"), (True, False, 1, "j"), (True, False, 3, "j"),
        (True, False, 4, "j"), None, None, None, None, None, None, None,
    ]


def results(spark):
    cases = [(f"c{i}", "ley" if i < 4 else "ia", "p", "r", "f", "buscar") for i in range(6)]
    trace = [("buscar", "{}", True)]
    answers = [
        ("c0", " hola ", trace, verdict(cita_correcta=True), None),
        ("c1", "x", [], verdict(correcta=False, score=1), None),
        ("c2", "x", trace, "{", None),
        ("c3", "x", trace, verdict(), "cuota"),
        ("c4", "x", trace, None, "caida"),
    ]
    return ev.case_results(spark.createDataFrame(cases, CASE), spark.createDataFrame(answers, ANSWER))


def test_case_results(spark):
    got = {r["id"]: r for r in results(spark).collect()}
    assert [got[f"c{i}"]["error"] for i in range(6)] == [
        None, None, ev.BAD_VERDICT, "cuota", "caida", ev.NO_ANSWER]
    assert got["c0"]["tool_correcta"] and not got["c1"]["tool_correcta"]
    assert (got["c3"]["score"], got["c3"]["respuesta_agente"], got["c3"]["tools_usadas"]) == (1, "", [])


def test_metrics(spark):
    g = ev.global_metrics(results(spark)).first()
    assert (g["n"], g["n_ok"], g["respuesta_correcta_pct"], g["cita_correcta_pct"], g["score_promedio"]) == (6, 2, 50.0, 50.0, 2.5)
    assert g["hubo_errores"]
    by = {r["categoria"]: r for r in ev.category_metrics(results(spark)).collect()}
    assert by["ley"]["n"] == 2 and by["ia"]["n"] == 0 and by["ia"]["score_promedio"] is None
    none = ev.global_metrics(results(spark).limit(0)).first()
    assert (none["n"], none["score_promedio"], none["hubo_errores"]) == (0, 0.0, False)


def test_report_lines(spark):
    lines = [r["line"] for r in ev.report_lines(results(spark)).orderBy("section", "item").collect()]
    assert "| Respuesta correcta | 50.0% |" in lines[0]
    assert lines[1] == "| ia | 0 | - | - | - |" and lines[2] == "| ley | 2 | 50% | 50% | 2.50 |"
    assert "> ERROR al evaluar este caso: cuota" in lines[6] and "```\nhola\n```" in lines[3]


def test_tool_check(spark):
    df = spark.createDataFrame(
        [(1, [], "a"), (2, ["a"], "a"), (3, ["b"], "a")], "i int, tools_usadas array<string>, tool_esperada string")
    assert [r["resultado"] for r in ev.tool_check(df).orderBy("i").collect()] == ["sin_tool", "ok", "otra_tool"]


def test_golden_set_and_corpus(spark, folder):
    casos = [{"id": "x", "pregunta": "p1", "categoria": "ley"}, {"pregunta": "p2"}, {"pregunta": "p3"}]
    with open(f"{folder}/g.json", "w", encoding="utf-8") as f:
        json.dump({"_meta": {"v": 1}, "casos": casos}, f, indent=1)
    got = ev.with_defaults(read_golden_set(spark, f"{folder}/g.json", limit=2)).orderBy("pos").collect()
    assert [(r["id"], r["categoria"], r["tool_esperada"]) for r in got] == [("x", "ley", ""), ("caso_2", "", "")]
    for name, text in (("b.v2.txt", "línea 1\nlínea 2\n"), ("a.txt", "x"), ("c.md", "no")):
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    assert {tuple(r) for r in read_corpus(spark, folder).collect()} == {("b.v2", "línea 1\nlínea 2\n"), ("a", "x")}
