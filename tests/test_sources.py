from __future__ import annotations

import json
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tablemend.session import cut_lineage, scratch_path, shared_dir
from tablemend.sources import metrics, tables
from tablemend.sources.pages import section_text
from tablemend.spec import ALLERGENS, TRIAL_DESIGN
from tablemend.streaming.repair import append_parquet, mark_violations, repair_stream


def test_the_shared_folder_is_the_one_the_session_names(spark):
    first = shared_dir(spark)
    assert shared_dir(spark) == first and scratch_path(spark, "a") != scratch_path(spark, "a")
    assert cut_lineage(spark.range(5)).count() == 5


def test_null_symbols_and_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('k;v\n1;"?"\n2;-\n3;"a;""b"""\n4;\n5;[]\n6;""\n')
    rows = tables.read_csv(spark, str(tmp_path / "t.csv"), sep=";").orderBy("k").collect()
    assert [r["v"] for r in rows] == [None, None, 'a;"b"', None, None, None]


def test_schema_is_inferred_from_all_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d,e,f\n" + "1,1,x,?,true,3000000000\n" * 1200 + "2,0.5,1,7,false,-\n\"1\",-1e3,,,,\n")
    kinds = [f.dataType.simpleString() for f in tables.inferred_schema(spark, str(tmp_path / "t.csv")).fields]
    assert kinds == ["int", "double", "string", "int", "boolean", "bigint"]


def test_texts_come_back_as_they_were(spark, tmp_path):
    texts = ["a\nb", "\r\n", "\\n", "c:\\new\\\\\nx", 'say "hi", or;', "\\", "?", "é\t "]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    path = tables.write_csv(df, str(tmp_path / "t"))
    back = tables.read_csv(spark, path, symbols=(), escaped=True)
    assert [r.t for r in back.orderBy(F.col("k").cast("int")).collect()] == texts
    (tmp_path / "foreign.csv").write_text('k,t\n1,"two\nlines"\n')
    assert tables.read_csv(spark, str(tmp_path / "foreign.csv")).first().t == "two\nlines"


def test_upsert_keeps_other_labels_and_key_types(spark, tmp_path):
    path, schema = str(tmp_path / "m"), "dataset string, strategy string, attr string, errors long"

    def put(*rows):
        metrics.upsert_metrics(spark.createDataFrame(rows, schema), path, ["dataset", "strategy"], ["attr"])

    put(("001", "s", "nuts", 1), ("001", "s", None, 2), ("002", "s", "nuts", 3))
    put(("001", "s", "soy", 4), ("001", "s", None, 5))
    rows = sorted(map(str, map(tuple, metrics.read_metrics(spark, path, schema).select("dataset", "strategy", "attr", "errors").collect())))
    assert rows == sorted(map(str, [("001", "s", "nuts", 1), ("001", "s", None, 5), ("001", "s", "soy", 4), ("002", "s", "nuts", 3)]))


def test_two_writers_from_the_same_state_lose_nothing(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "m"), "dataset string, strategy string, attr string, errors long"

    def put(*rows):
        metrics.upsert_metrics(spark.createDataFrame(rows, schema), path, ["dataset", "strategy"], ["attr"])

    def rows_of(df):
        return sorted(tuple(r) for r in df.collect())

    put(("a", "s 1/%", "nuts", 1), ("b", "s", "nuts", 3))
    before = metrics.read_metrics(spark, path, schema)
    real, tries = metrics.publish, []

    def late(spark, path, state):
        tries.append(state.number)
        if len(tries) == 1:  # another writer is first
            monkeypatch.setattr(metrics, "publish", real)
            put(("a", "s 1/%", "milk", 5), ("c", "s", "nuts", 6))
            monkeypatch.setattr(metrics, "publish", late)
        return real(spark, path, state)

    monkeypatch.setattr(metrics, "publish", late)
    put(("a", "s 1/%", "soy", 4), ("b", "s", "nuts", 7))
    assert tries == [2, 3]
    assert rows_of(metrics.read_metrics(spark, path, schema)) == [
        ("a", "s 1/%", "milk", 5), ("a", "s 1/%", "nuts", 1), ("a", "s 1/%", "soy", 4), ("b", "s", "nuts", 7), ("c", "s", "nuts", 6),
    ]
    # Who began to read before still sees the whole old version, and files without a manifest are seen by nobody.
    assert rows_of(before) == [("a", "s 1/%", "nuts", 1), ("b", "s", "nuts", 3)]
    monkeypatch.setattr(metrics, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        put(("a", "s 1/%", "nuts", 100))
    assert metrics.read_metrics(spark, path, schema).filter("errors = 100").count() == 0
    assert metrics.read_metrics(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(ValueError, match="holds no rows"):
        metrics.read_metrics(spark, str(tmp_path / "none"))


def test_suffixed_names():
    assert tables.suffixed("/data/x.csv", "_fixed") == "/data/x_fixed.csv"
    assert tables.suffixed("/data/x", "_v1") == "/data/x_v1"


def test_contracts_follow_the_description():
    assert tables.spec_contract(ALLERGENS) == {a: "int" for a in ALLERGENS.labels}
    assert tables.spec_contract(TRIAL_DESIGN) == {}


def test_jdbc_settings_come_from_the_caller(spark):
    options = tables.jdbc_options("jdbc:some:db", user="u", driver=None, fetchsize="100")
    assert options == {"url": "jdbc:some:db", "user": "u", "fetchsize": "100"}
    df = spark.createDataFrame([(1, "x")], "nuts int, note string")
    assert tables.column_types(df, ["nuts"]) == "`nuts` INTEGER"
    assert tables.column_types(spark.createDataFrame([("x",)], "TEXT string"), []) == ""
    odd = spark.createDataFrame([("1",), (None,), ("1.5",)], "n string")
    assert [r[0] for r in odd.filter("n IS NULL OR n = '1'").select(tables._whole(F.col("n"), "n")).collect()] == [1, None]
    with pytest.raises(Exception, match="n is no integer: 1.5"):
        odd.select(tables._whole(F.col("n"), "n")).collect()


def test_nested_results_are_flattened(spark):
    sweep = {"nuts": {"errors": 48, "avg_proba": 0.85, "threshold": [0, 0.85], "repairs": [55, 40],
                      "correct_repairs": [22, 17], "precision": [0.4, 0.42], "recall": [0.46, 0.35], "F-1": [0.43, 0.38]}}
    prefixes = {"0": {"1": {"correct_repairs": 16, "repairs": 24, "errors": 21}}}
    training = {"with_constraints": {"m": {"nuts": {"ir": 0.1, "duration": 1.5, "proba": 0.9}}}}
    strategies = {"repair methods": [{"key": "all", "Number of errors": 5, "Number of repairs": 3, "Number of correct repairs": 2}]}

    def doc(value):
        return spark.createDataFrame([(json.dumps(value),)], "value string")

    rows = metrics.flatten_sweep(doc(sweep)).orderBy("threshold").collect()
    assert [tuple(r) for r in rows] == [("nuts", 0.85, 0.0, 48, 55, 22), ("nuts", 0.85, 0.85, 48, 40, 17)]
    assert tuple(metrics.flatten_prefixes(doc(prefixes)).first()) == (1, 1, 21, 24, 16)
    assert tuple(metrics.flatten_training(doc(training)).first()) == ("with_constraints", "m", "nuts", 0.1, 1.5, 0.9)
    assert tuple(metrics.flatten_strategies(doc(strategies)).first()) == ("all", 5, 3, 2)


def test_nested_results_come_back_from_their_documents(spark):
    prefixes = spark.createDataFrame([(1, 1, 5, 3, 2), (1, 2, 9, 4, 2), (2, 1, 7, 0, 0)], "source_rank int, n_attrs int, errors long, repairs long, correct long")
    assert sorted(metrics.flatten_prefixes(metrics.prefix_documents(prefixes)).collect()) == sorted(prefixes.collect())
    assert metrics.flatten_prefixes(metrics.prefix_documents(prefixes.filter("false"))).count() == 0
    schema = "strategy string, model string, attr string, ir double, duration double, proba double"
    records = spark.createDataFrame([("s", "m", "nuts", 0.1, None, 1 / 3), ("s", "m", "eggs", 1.0, 2.5, 0.5), ("t", "m", "nuts", 0.0, 0.0, 1.0)], schema)
    assert sorted(map(str, metrics.flatten_training(metrics.training_documents(records)).collect())) == sorted(map(str, records.collect()))
    rated = spark.createDataFrame([("b", 5, 3, 2, 0.6, 0.4, 0.5), ("a", 1, 0, 0, None, 0.0, 0.0)], "strategy string, errors long, repairs long, correct long, precision double, recall double, f1 double")
    assert [tuple(r) for r in metrics.flatten_strategies(metrics.strategy_documents(rated)).collect()] == [("a", 1, 0, 0), ("b", 5, 3, 2)]
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        metrics.prefix_documents(prefixes.unionByName(prefixes)).collect()


def test_sections_by_id_and_by_tag(spark):
    html = (
        "<html><body><div id='x'>no</div><div id='panel'> Milk, <b>soy</b><div>nested &amp; deep</div><br>end</div>"
        "<p>after</p></body></html>"
    )
    df = spark.createDataFrame([(html,), ("<p>none</p>",), (None,)], "h string")
    got = [r[0] for r in df.select(section_text(F.col("h"), element_id="panel")).collect()]
    assert got == ["Milk, soy nested & deep end", "", ""]
    assert [r[0] for r in df.select(section_text(F.col("h"), tag="p")).collect()] == ["after", "none", ""]
    coded = spark.createDataFrame([("<div>a<script>var x = '<b>';</script> b<style>p{}</style>c</div>",)], "h string")
    assert coded.select(section_text(F.col("h"), tag="div")).first()[0] == "a b c"
    with pytest.raises(ValueError):
        section_text(F.col("h"))


def test_articles_of_all_pages_hold_their_paragraphs(spark, sf):
    class Words(HTMLParser):
        """Every text piece between the first article's tags, found independently."""

        def __init__(self):
            super().__init__()
            self.inside, self.done, self.words = 0, False, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article" and not self.done

        def handle_endtag(self, tag):
            if tag == "article" and self.inside:
                self.inside -= 1
                self.done = self.inside == 0

        def handle_data(self, data):
            if self.inside:
                self.words += data.split()

    got = {r["page_id"]: r["section"] for r in registry.queries()["page_articles"](spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/pages.parquet").collect():
        parser = Words()
        parser.feed(row["html"])
        assert "".join(got[row["page_id"]].split()) == "".join(parser.words)


def test_checks_and_gate_on_a_stream(spark, sf, tmp_path):
    from tablemend.catalog.base import RULES, lines

    base = lines(spark, sf).withColumns({"pred": F.lit(1), "conf": (F.col("l_orderkey") % 10) / 10.0})
    base.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = repair_stream(mark_violations(stream, RULES), "finished", 0.5)
    append_parquet(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    wanted = repair_stream(mark_violations(base, RULES), "finished", 0.5)
    columns = ["l_orderkey", "l_linenumber", "l_suppkey", "finished", "finished_orig", "rule_ids"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns)
    assert got.exceptAll(wanted.select(*columns)).count() == 0 and got.count() == base.count()
