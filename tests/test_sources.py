import pytest

from tamiz.operators.explore import column_types
from tamiz.plans.catalog import Catalog
from tamiz.sources import bigquery, jdbc
from tamiz.sources.csv import load_csv, sniff
from tamiz.sources.facts import load_digest
from tamiz.sources.table import SourceTable


def write(folder, name, text, encoding="utf-8"):
    with open(f"{folder}/{name}", "wb") as f:
        f.write(text.encode(encoding))
    return f"{folder}/{name}"


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_separators_and_encodings(spark, folder, sep, encoding):
    lines = [["id", "niño", "nota"], ["1", "José, el 1º", "a"], ["2", "Ñandú", "b"], ["3", "x", ""]]
    cells = [[f'"{c}"' if "," in c else c for c in line] for line in lines]
    path = write(folder, "t.csv", "\n".join(sep.join(c) for c in cells) + "\n", encoding)
    table = load_csv(spark, path)
    assert table.df.columns == ["id", "niño", "nota"]
    assert [tuple(r) for r in table.df.orderBy("id").collect()] == [
        (1, "José, el 1º", "a"), (2, "Ñandú", "b"), (3, "x", None)]
    assert table.metadata["separator"] == sep
    assert table.metadata["encoding"] == ("latin-1" if encoding == "latin-1" else "utf-8")
    assert table.metadata["separator_auto_detected"] and table.metadata["shape"] == {"rows": 3, "columns": 3}


def test_character_cut_by_the_sniffing_window(spark, folder):
    for pad in range(4):
        head = "a,b\n"
        path = write(folder, f"w{pad}.csv", head + "x" * (4096 - len(head) - pad) + "😀ñ,1\n")
        assert sniff(spark, path).first()["encoding"] == "utf-8"
    bad = write(folder, "bad.csv", "a,b\nñ,1\n" + "x,1\n" * 2000, "latin-1")
    assert sniff(spark, bad).first()["encoding"] == "latin-1"


def test_cell_types(spark, folder):
    text = (
        "entero,con_nulos,real,logico,logico_nulo,fecha,texto,vacia,grande\n"
        "1,1,1.5,True,true,2024-01-02,NA ,,9223372036854775808\n"
        "-2,NA,1e3,False,,2024-01-03,none,NaN,1\n"
        '3,3,inf,TRUE,false,2024-01-04,"a ""b"", c",null,2\n'
    )
    t = load_csv(spark, write(folder, "t.csv", text))
    assert dict(t.df.dtypes) == {
        "entero": "bigint", "con_nulos": "bigint", "real": "double", "logico": "boolean", "logico_nulo": "boolean",
        "fecha": "string", "texto": "string", "vacia": "double", "grande": "double",
    }
    assert t.metadata["kinds"]["con_nulos"] == "Int64"
    assert t.metadata["columns_all_null"] == ["vacia"]
    rows = t.df.orderBy("fecha").collect()
    assert [r["texto"] for r in rows] == ["NA ", "none", 'a "b", c'] and rows[1]["con_nulos"] is None
    assert [r["name"] for r in column_types(t.df).orderBy("col_pos").collect()] == t.df.columns


def test_quoted_line_end_and_ragged_rows(spark, folder):
    t = load_csv(spark, write(folder, "q.csv", 'a,b\n1,"x\ny"\n2,z\n'))
    assert t.df.orderBy("a").first()["b"] == "x\ny"
    t = load_csv(spark, write(folder, "r.csv", "a,b\n1,x\n2\n3,y,z\n"))
    assert t.df.count() == 3 and t.metadata["warnings"][0] == "misshaped_rows=2"


def test_files_of_one_table_with_different_formats(spark, folder):
    write(folder, "1.csv", "a,b\n1,ñ\n")
    write(folder, "2.csv", "a;b\n2;ñ\n", "latin-1")
    t = load_csv(spark, folder, glob="*.csv")
    assert {tuple(r) for r in t.df.collect()} == {(1, "ñ"), (2, "ñ")}


def test_limits_and_errors(spark, folder):
    path = write(folder, "n.csv", "a,b\n" + "".join(f"{i},2\n" for i in range(50)))
    assert [r["a"] for r in load_csv(spark, path, nrows=10).df.orderBy("a").collect()] == list(range(10))
    given = load_csv(spark, path, sep=";", encoding="utf-8").metadata
    assert not given["separator_auto_detected"] and given["shape"]["columns"] == 1
    with pytest.raises(FileNotFoundError):
        load_csv(spark, f"{folder}/no.csv")
    digest = load_digest(load_csv(spark, path))
    assert digest["columnas"] == ["a", "b"] and digest["shape"]["rows"] == 50


def test_jdbc_options():
    assert jdbc.read_options('cli"entes', limit=3) == {"query": 'SELECT * FROM "public"."cli""entes" LIMIT 3'}
    assert jdbc.read_options("t", schema="s", partition=("id", 0, 100, 8)) == {
        "dbtable": '"s"."t"', "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "8"}
    assert jdbc.read_options(query="SELECT 1") == {"query": "SELECT 1"}
    for bad in ({}, {"table": "t", "query": "SELECT 1"}, {"query": "DROP TABLE t"}):
        with pytest.raises(ValueError):
            jdbc.read_options(**bad)
    made = jdbc.connection_options({"DB_HOST": "h", "DB_SSLMODE": "require"})
    assert made["url"] == "jdbc:postgresql://h:5432/gobernanza" and made["sslmode"] == "require"
    assert "sslmode" not in jdbc.connection_options({})


def test_bigquery_options():
    env = {"GCP_PROJECT": "p"}
    assert bigquery.read_options("d.t", env=env) == {"parentProject": "p", "table": "d.t"}
    assert bigquery.read_options("d.t", limit=5, env={})["query"] == "SELECT * FROM `d.t` LIMIT 5"
    assert bigquery.read_options(query="SELECT 1", project="q", env=env)["parentProject"] == "q"
    for bad in ({}, {"table": "a b"}, {"table": "t`"}, {"table": "t", "query": "q"}):
        with pytest.raises(ValueError):
            bigquery.read_options(**bad, env={})


def test_catalog(spark, folder):
    path = write(folder, "clientes.csv", "id,email\n" + "".join(f"{i},u{i}@x.cl\n" for i in range(5)))
    catalog = Catalog(spark, f"{folder}/store", {"clientes": path}, lambda s, p: load_csv(s, p))
    assert catalog.listing() == {
        "tablas_cargadas": [], "tablas_perfiladas": [], "tablas_disponibles": ["clientes"]}
    first = catalog.profile("clientes").first()["digest"]
    assert '"columnas_pii":["email"]' in first
    assert catalog.profile("clientes").collect()[0]["digest"] == first
    assert catalog.profiled() == ["clientes"] and catalog.loaded() == ["clientes"]
    mark = catalog.fingerprint(catalog.get("clientes"))
    assert mark == catalog.fingerprint(load_csv(spark, path)) and mark.endswith("-1")
    write(folder, "clientes.csv", "id,email\n" + "".join(f"{i},v{i}@x.cl\n" for i in range(5)))
    assert mark != catalog.fingerprint(load_csv(spark, path))
    # The same name for other content is profiled anew.
    other = spark.range(3)
    catalog.register("clientes", SourceTable(other, "memory", "clientes"))
    assert '"filas":3' in catalog.profile("clientes").first()["digest"]
    assert spark.table("clientes").count() == 3
    catalog.reset()
    assert catalog.loaded() == []
    with pytest.raises(KeyError, match="available"):
        catalog.profile("no")


def test_every_file_has_its_own_header(spark, folder):
    write(folder, "1.csv", "a,b\n1,x\n2,y\n")
    write(folder, "2.csv", "b,a\nz,3\n")
    write(folder, "3.csv", "a\n4\n")
    t = load_csv(spark, folder, glob="*.csv")
    assert sorted((r["a"], r["b"]) for r in t.df.collect()) == [(1, "x"), (2, "y"), (3, "z"), (4, None)]
    assert "column_sets=2" in t.metadata["warnings"]


@pytest.mark.parametrize("split", ["128m", "200b"])
def test_rows_do_not_depend_on_splits(spark, folder, split):
    path = write(folder, "m.csv", "a;b\n" + "".join(f"{i};'x\ny{i}'\n" for i in range(300)))
    skipped = write(folder, "s.csv", "nota\n\nmas; notas\n" + "a;b\n" + "".join(f"{i};y{i}\n" for i in range(300)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = load_csv(spark, path, sep=";", options={"quote": "'"}).df.collect()
        assert sorted(r["a"] for r in rows) == list(range(300)) and all(r["b"] == f"x\ny{r['a']}" for r in rows)
        rows = load_csv(spark, skipped, skiprows=3).df.collect()
        assert sorted((r["a"], r["b"]) for r in rows) == [(i, f"y{i}") for i in range(300)]
        assert load_csv(spark, [path, skipped], skiprows=0, sep=";").df.count() > 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
