import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers as R
from millrace.sources import sinks
from millrace.streaming import events as S

EVENTS = "/root/testdata/sf0.001/events.parquet"


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def xlsx():
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row><row><c r="B3"><v>9</v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>name</t></si><si><t>x</t></si></sst>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}"><sheets><sheet name="KPIs"/></sheets></workbook>')
    return out.getvalue()


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿name ; n;date\nx;1;2024-01-02\ny;NA;never\n\"z;é\";3;\n".encode())
    df = R.load_csv(spark, str(path), dates=["date"])
    assert df.columns == ["name", "n", "date"] and dict(df.dtypes)["n"] == "bigint"
    rows = df.orderBy("name").collect()
    assert [r.n for r in rows] == [1, None, 3] and rows[2].name == "z;é" and [r.date is None for r in rows] == [False, True, True]
    assert R.load_csv(spark, str(path), limit=1).count() == 1
    latin = tmp_path / "b.csv"
    latin.write_bytes("a,b\né,1\n".encode("latin-1"))
    assert R.sniff(spark, str(latin)) == (",", "iso-8859-1") and R.load_csv(spark, str(latin)).first().a == "é"


def test_tabular_headers(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("Date\tNet Sales ($)\n2024-01-01\t5.5\n")
    df = R.load_tabular(spark, str(path))
    assert df.columns == ["date", "net_sales"] and dict(df.dtypes) == {"date": "timestamp", "net_sales": "double"}


def test_xlsx_and_docx(spark, tmp_path):
    (tmp_path / "k.xlsx").write_bytes(xlsx())
    df = R.load_xlsx(spark, str(tmp_path / "k.xlsx"), "KPIs")
    assert [(r.name, r.n) for r in df.collect()] == [("x", 7), (None, 9)]
    assert R.docx_text(docx()) == "Hello world\na\tb"


def test_json(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"text": "a"}\n\n# note\n{"text": "b"}\n')
    assert R.load_jsonl(spark, str(path), "text string", comment="#").count() == 2
    path.write_text('{"text": "a"}\n{broken\n')
    assert R.load_jsonl(spark, str(path), "text string", lenient=True).count() == 1
    with pytest.raises(Exception, match="(?i)malformed|parse|record"):
        R.load_jsonl(spark, str(path), "text string").collect()
    doc = tmp_path / "kg.json"
    doc.write_text(json.dumps({"tenant_id": "t0", "entity_name": "Acme plc", "doc_id": "d", "chunks": [{"text": "x", "page": 1, "chunk_id": "c"}]}))
    assert R.load_kg_documents(spark, str(doc)).first()[:] == ("t0", "org:acme plc", "d", 1, "c", "x")
    assert R.load_json(spark, str(doc)).count() == 1
    alias = tmp_path / "alias.json"
    alias.write_text('{"org:a": ["x", "y"]}')
    assert R.load_aliases(spark, str(alias)).count() == 2
    seeds = tmp_path / "seeds.jsonl"
    seeds.write_text('{"question": "q", "answer": "a"}\n{"question": " "}\n')
    assert [list(r.references) for r in R.load_eval_seeds(spark, str(seeds)).collect()] == [["a"]]


def test_directory(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("so­ft text\n\n\n\nend")
    (tmp_path / "in" / "sub" / "b.docx").write_bytes(docx())
    (tmp_path / "in" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "rows.csv").write_text("a,b\n1,2\n")
    (tmp_path / "in" / "skip.bin").write_bytes(b"x")
    files = R.load_texts(R.scan(spark, str(tmp_path / "in"), [".txt", ".docx", ".csv"]))
    got = {r.path.rpartition("/")[2]: r for r in files.collect()}
    assert got["a.txt"].text == "soft text\n\nend" and got["b.docx"].text == "Hello world\na\tb" and got["rows.csv"].text == "a | b\n1 | 2"
    assert not got["bad.docx"].ok and got["bad.docx"].error and "skip.bin" not in got
    assert sinks.index_report(files).first()[:2] == (3, 1)


def test_triples_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("subject,predicate,object,confidence\na,is,b,0.5\n,is,c,1\n")
    assert [r.confidence for r in R.load_triples(spark, str(tmp_path / "t.csv")).collect()] == [0.5]
    df = spark.createDataFrame([("c1", 1, 0.5), ("c2", 2, 1.5)], "collection string, id int, score double")
    sinks.write_collection(df, str(tmp_path / "items"))
    sinks.write_collection(df.where("id = 1").withColumn("score", F.lit(9.0)), str(tmp_path / "items"))
    assert {(r.collection, r.score) for r in spark.read.parquet(str(tmp_path / "items")).collect()} == {("c1", 9.0), ("c2", 1.5)}
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_jsonl(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2 and spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert [r.score for r in sinks.with_averages(df, "collection", ["score"]).orderBy("part").collect()][-1] == 1.0
    assert "<td>c1</td>" in sinks.html_report(df) and sinks.fixed(df, ["score"]).first().score == "0.500000"


def test_streams_agree_with_tables(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    schema = events.schema

    def stream():
        return S.source(spark, str(tmp_path / "in"), schema, files=2)

    S.drain(S.deduplicate(stream(), late="3650 days"), str(tmp_path / "d"), str(tmp_path / "dc"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == events.count()
    windows = S.tumbling(stream(), late="3650 days")
    windows.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = {(r.start, r.event_type): r.n for r in S.tumbling(events).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("w").collect()} == want
    bucket = S.token_bucket_stream(stream().where("user_id < 5"), rate=1 / 3600, burst=2)
    S.drain(bucket, str(tmp_path / "b"), str(tmp_path / "bc"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == events.where("user_id < 5").count()


def test_bucket_and_sessions(spark):
    assert S.bucket_fold([0, 0, 0, 1, 10], 1.0, 2.0, 2.0, None)[0] == [True, True, False, True, True]
    rows = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00', 1), (1, timestamp'2024-01-01 00:10:00', 2), (1, timestamp'2024-01-01 02:00:00', 3) as t(user_id, ts, event_id)")
    assert sorted(r.n for r in S.sessions(rows).collect()) == [1, 2]
    assert S.token_bucket(rows, rate=1 / 3600, burst=1).where("allowed").count() == 2
