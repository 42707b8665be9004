"""Readers, streams and the driver's entry point."""

import functools
import importlib.util
import os
import re
import shutil
import subprocess
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill import __main__ as cli
from pagemill.functions.tokencount import token_counter
from pagemill.operators import semantic, session
from pagemill.sources import pages as sources
from pagemill.sources import pdf, sinks
from pagemill.sources.pdf_file import PdfFile, written
from pagemill.streaming import sessions as streams

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_pages(spark):
    docs = spark.createDataFrame([(1, "\n".join("abcdefg")), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(map(tuple, sources.pages_of_lines(docs, 3).collect()))
    assert got == [(1, 1, "a\nb\nc"), (1, 2, "d\ne\nf"), (1, 3, "g"), (2, 1, ""), (3, 1, "")]


def test_gold_and_questions(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text('// note\n\n{"q": "why?", "pages": [1, 2]}\n  // x\n')
    (tmp_path / "q.txt").write_text(" one \n\ntwo\n")
    assert [tuple(r) for r in sources.gold_questions(spark, str(tmp_path / "gold.jsonl")).collect()] == [("why?", [1, 2])]
    assert [r["text"] for r in sources.question_lines(spark, str(tmp_path / "q.txt")).collect()] == ["one", "two"]


def test_scan(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt", ".hidden/d.pdf", "x/y/z/e.pdf", "x/y/z/w/f.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    got = sources.scan_files(spark, [str(tmp_path), str(tmp_path) + "/"]).collect()
    assert sorted(r["name"] for r in got) == ["a.pdf", "b.PDF", "e.pdf"]
    assert all(r["size"] == 3 and r["mtime_ns"] > 0 for r in got)
    (row,) = sources.file_sha256(spark, str(tmp_path / "a.pdf")).collect()
    assert row["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


PDF_PAGES = ["One (two) \\ three\nsee section 2", "", "Ünïcode 5 €\n| a | b |\n| c | d |\ntext", "last"]


@pytest.fixture()
def pdfs(spark, tmp_path):
    spark.dataSource.register(pdf.PdfPages)
    (tmp_path / "plain.pdf").write_bytes(written(PDF_PAGES, ["First", "Second (b)"]))
    (tmp_path / "coded.pdf").write_bytes(written(PDF_PAGES, compress=True))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4\n no objects")
    (tmp_path / "locked.pdf").write_bytes(written(["x"]) + b"trailer << /Encrypt 9 0 R >>")
    names = ["plain", "coded", "broken", "locked"]
    return ",".join(str(tmp_path / f"{n}.pdf") for n in names)


def read_pdfs(spark, paths, **options):
    made = spark.read.format("pdf_pages").option("path", paths)
    for k, v in {"extractor": "builtin"}.items() | options.items():
        made = made.option(k, v)
    return made.load()


def test_pdf_pages_keep_their_numbers_and_broken_files_are_skipped(spark, pdfs):
    rows = read_pdfs(spark, pdfs).collect()
    for name in ("plain", "coded"):
        assert [(r["page"], r["text"]) for r in rows if name in r["path"]] == list(enumerate(PDF_PAGES, start=1))
    assert {os.path.basename(r["path"]) for r in rows} == {"plain.pdf", "coded.pdf"}
    status = {os.path.basename(r["path"]): r for r in read_pdfs(spark, pdfs, view="status").collect()}
    assert {n: r["ok"] for n, r in status.items()} == {"plain.pdf": True, "coded.pdf": True, "broken.pdf": False, "locked.pdf": False}
    assert status["plain.pdf"]["n_pages"] == 4 and "no catalog" in status["broken.pdf"]["error"] and "encrypted" in status["locked.pdf"]["error"]
    with pytest.raises(Exception, match="no catalog|encrypted"):
        read_pdfs(spark, pdfs, onError="fail").collect()
    with pytest.raises(Exception, match="no such file"):
        read_pdfs(spark, "/nowhere/a.pdf", failOnMissing="true").collect()


def test_pdf_outline_and_tables(spark, pdfs):
    first = pdfs.split(",")[0]
    assert [(r["pos"], r["title"]) for r in read_pdfs(spark, pdfs, view="outline").collect()] == [(0, "First"), (1, "Second (b)")]
    got = [(r["page"], r["table_no"], r["row_no"], r["cells"]) for r in read_pdfs(spark, first, view="tables").collect()]
    if importlib.util.find_spec("pdfplumber") is None:
        assert got == [(3, 1, 1, ["a", "b"]), (3, 1, 2, ["c", "d"])]


def test_pdf_extractor_is_chosen(spark, pdfs):
    assert pdf.extractor_name("pypdf") == "pypdf" and pdf.extractor_name("builtin") == "builtin"
    there = [n for n, m in pdf.EXTRACTORS.items() if importlib.util.find_spec(m)]
    assert pdf.extractor_name() == (there[0] if there else "builtin")
    assert read_pdfs(spark, pdfs.split(",")[1], extractor="auto").count() == 4


def test_pdf_of_object_streams_and_fonts_with_maps():
    inner = b"1 0 2 37 " + b"<< /Type /Catalog /Pages 2 0 R >>    << /Type /Pages /Kids [4 0 R] /Count 1 >>"
    packed = zlib.compress(inner)
    cmap = b"begincmap 1 beginbfchar <0041> <0042> endbfchar 1 beginbfrange <0050> <0052> <0061> endbfrange endcmap"
    shown = b"BT /F1 9 Tf [<0041> -300 <0050> 5 <00510052>] TJ 0 -12 Td <0041> Tj ET"
    body = b"%PDF-1.5\n3 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj\n"
    body += b"4 0 obj << /Type /Page /Contents [5 0 R] /Resources << /Font << /F1 << /ToUnicode 6 0 R >> >> >> >> endobj\n"
    body += b"5 0 obj << >> stream\n" + shown + b"\nendstream endobj\n6 0 obj << >> stream\n" + cmap + b"\nendstream endobj\n"
    file = PdfFile(body)
    assert [file.text(p) for p in file.pages()] == ["B abc\nB"]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "x\n| a | b |\nc | d | e"), ("d", 2, "y")], "doc_id string, page long, text string")
    sinks.write_tables(pages, str(tmp_path / "t"))
    rows = spark.read.option("header", "true").csv(str(tmp_path / "t")).orderBy("row_no").collect()
    assert [(r["c1"], r["c2"], r["c3"]) for r in rows] == [("a", "b", None), ("c", "d", "e")]
    sinks.write_blocks(pages, str(tmp_path / "b"), 1)
    assert spark.read.json(str(tmp_path / "b")).count() == 2
    sinks.write_text(pages, str(tmp_path / "s"))
    assert spark.read.option("wholetext", "true").text(str(tmp_path / "s")).count() >= 1
    files = spark.createDataFrame([("/b", "b"), ("/a", "z"), ("/c", "c")], "path string, name string")
    assert tuple(sinks.inventory(files, 2).first()) == (3, ["b", "z"])


def test_token_counter(spark):
    import public_tokenizers

    texts = spark.createDataFrame([(0, "hello world"), (1, None), (2, "")], "i int, text string")
    count = token_counter(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    assert [r["n"] for r in texts.select("i", count(F.col("text")).alias("n")).orderBy("i").collect()] == [2, 1, 1]
    assert [r["n"] for r in texts.select("i", token_counter()(F.coalesce("text", F.lit(""))).alias("n")).orderBy("i").collect()] == [2, 1, 1]


def test_a_model_that_fails_fails_once():
    tries = []

    def make():
        tries.append(1)
        raise ImportError("no model")

    sticky = semantic.Sticky(make)
    assert sticky.get() is None and sticky.get() is None and len(tries) == 1 and "no model" in sticky.reason


def test_streams_equal_the_batch(spark, tmp_path):
    log = [(1, 1, "search", None, 100, 10, 2), (2, 1, "clear", "a", 0, 0, 0), (3, 1, "search", None, 50, 80, 1), (4, 1, "clear", None, 0, 0, 0), (5, 1, "search", None, 7, 1, 1), (6, 2, "search", None, 9, 1, 3)]
    schema = "seq long, session_id long, op string, doc_id string, naive_tokens long, actual_tokens long, chunks int"
    batch = spark.createDataFrame(log, schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "log"))
    q = streams.running_ledger(stream).writeStream.format("memory").queryName("ledger").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    names = ["session_id", "seq", "searches", "chunks", "actual_tokens", "naive_tokens", "saved_tokens"]
    got = sorted(map(tuple, spark.table("ledger").select(*names).collect()))
    assert got == sorted(map(tuple, session.running_ledger(batch).select(*names).collect()))


def streamed(spark, tmp_path, name, batches, made, mode):
    """The rows that a stream gives over micro-batches, one file each, in order, with the micro-batch's number."""
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        found = [f for f in os.listdir(tmp_path / name) if f.endswith(".parquet") and not f.startswith("b")]
        os.rename(tmp_path / name / found[0], tmp_path / name / f"b{i}.parquet")
        os.utime(tmp_path / name / f"b{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    out = []
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = made(stream).writeStream.foreachBatch(lambda df, i: out.extend((i, r) for r in df.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return out


def test_catalog_stream_equals_the_batch(spark, tmp_path):
    log = [
        [(1, 1, "ingest", "a", 2), (2, 1, "ingest", "a#1", 3), (9, 2, "ingest", "c", 1)],
        [(4, 1, "clear", "a", 0), (5, 1, "ingest", "b", 1), (10, 3, "clear", None, 0)],
        [(3, 1, "ingest", "a", 7), (8, 3, "ingest", "late", 1), (6, 1, "ingest", "a#2", 4)],
        [(11, 2, "clear", None, 0), (12, 2, "ingest", "d", 5), (13, 1, "clear", "b", 0), (14, 1, "search", None, 0)],
        [(15, 3, "ingest", "x", 1), (7, 1, "ingest", "a#2", 6)],
    ]
    schema = "seq long, session_id long, op string, doc_id string, chunks int"
    batches = [spark.createDataFrame(rows, schema) for rows in log]
    told = {}
    for i, r in streamed(spark, tmp_path, "catalog", batches, streams.latest_catalog, "update"):
        told[r["session_id"], r["doc_id"]] = r
        if i == len(log) - 2:
            before = {k: r["seq"] for k, r in told.items() if r["loaded"]}
    want = lambda n: {(r["session_id"], r["doc_id"]): r["seq"] for r in session.catalog(spark.createDataFrame([x for b in log[:n] for x in b], schema).withColumn("ts", F.current_timestamp())).collect()}
    assert {k: r["seq"] for k, r in told.items() if r["loaded"]} == want(5) == {(1, "a#2"): 7, (2, "d"): 12, (3, "x"): 15}
    assert before == want(4)


def test_ledger_stream_orders_late_requests(spark, tmp_path):
    minute = lambda n: 1_700_000_000 + 60 * n
    log = [
        [(1, 1, 1, "search", None, 100, 10, 2), (4, 4, 1, "search", None, 50, 80, 1), (5, 5, 1, "clear", None, 0, 0, 0)],
        [(2, 2, 1, "clear", "a", 0, 0, 0), (3, 3, 1, "search", None, 30, 10, 1), (6, 6, 1, "search", None, 7, 1, 1), (7, 6, 2, "search", None, 9, 1, 3)],
        [(8, 60, 3, "search", None, 5, 1, 1)],
        [(9, 200, 3, "search", None, 6, 1, 1)],
    ]
    schema = "seq long, m long, session_id long, op string, doc_id string, naive_tokens long, actual_tokens long, chunks int"
    batches = [spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.lit(minute(0)) + F.col("m") * 60)).drop("m") for rows in log]
    got = [tuple(r) for _, r in streamed(spark, tmp_path, "late", batches, lambda s: streams.running_ledger(s, "10 minutes"), "append")]
    names = ["session_id", "seq", "searches", "chunks", "actual_tokens", "naive_tokens", "saved_tokens"]
    every = functools.reduce(lambda a, b: a.unionByName(b), batches)
    want = sorted(map(tuple, session.running_ledger(every).select(*names).collect()))
    assert sorted(got) == [r for r in want if r[1] != 9]  # the last request still waits


def test_ttl_stream(spark, tmp_path):
    events = spark.range(8).select((F.col("id") % 2).alias("user"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1000).alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    late = spark.createDataFrame([(0, 1_800_000_000)], "user long, s long").select("user", F.timestamp_seconds("s").alias("ts"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "e"))
    q = streams.ttl_sessions(stream, "user", 60).writeStream.format("memory").queryName("ttl").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["user"], r["n"]) for r in spark.table("ttl").collect())
    want = sorted((r["user"], r["n"]) for r in session.ttl_sessions(events, "user", 60).collect())
    assert got == want


def test_entry_and_queries(spark):
    sys.path.insert(0, REPO)
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "pagemill"):
        source = os.path.join(REPO, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; assert e.llm is None and 'search_topk' in e.queries() and not any(x.startswith('op') for x in e.queries()); print('ok')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert out.stdout.strip() == "ok", out.stderr


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, names in os.walk(os.path.join(REPO, "pagemill")):
        if "llm" in folder.split(os.sep):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"\bllm\b", f.read()), name


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "lease.pdf").write_bytes(written(["The lease begins in May, see section 3", "Rent and deposits", "3 Keys\nGENERAL TERMS\nKeys are returned at the end\n| key | 2 |"]))
    (tmp_path / "broken.pdf").write_bytes(b"no pdf")

    def said(*args):
        code = cli.main([args[0], str(tmp_path), "--extractor", "builtin", *args[1:]], spark)
        out = capsys.readouterr()
        return code, out.out, out.err

    assert said("files")[1] == "2 file(s)\nbroken.pdf\nlease.pdf\n"
    code, out, _ = said("inspect")
    assert code == 0 and "lease.pdf: 3 pages" in out and "broken.pdf: can't be read" in out and "lease.pdf p2: 17 characters  <- little text" in out
    assert said("inspect", "--search", "KEYS")[1].startswith("lease.pdf p3: 3 Keys GENERAL")
    assert said("inspect", "--pages", "2")[1] == "----- [page 2] -----\nRent and deposits\n"
    assert said("inspect", "--tables")[1] == "lease.pdf p3 table 1: key | 2\n"
    assert "lease.pdf chunk001_p1-2.txt" in said("inspect", "--blocks", "2")[1]
    code, out, err = said("slice", "--query", "when does the lease begin", "--k", "1", "--anchors")
    assert code == 0 and "[doc lease.pdf page 3]  [cross-ref]" in out and "- GENERAL TERMS" in out
    assert "top pages: lease.pdf:1" in err and "cross-refs: lease.pdf:3" in err
    code, out, err = said("slice", "--query", "zebra keys", "--passages")
    assert code == 0 and "[doc lease.pdf page 3 | passage]" in out and "WARNING: terms that matched nothing: zebra" in err
    code, out, err = said("slice", "--query", "zebra")
    assert code == 1 and "WARNING: no page matched" in err
