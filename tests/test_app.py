import io
import json
import threading
import uuid
import zipfile
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from paperloom.operators import bills, chunking
from paperloom.plans import app, providers
from paperloom.sources import files, models, pdf, store
from paperloom.streaming import ingest

INVOICE = "Invoice 7\nFrom: Acme\nCategory: Telecom\nInvoice date: 2025-03-04\nPayment due date: April 3, 2025\nAmount due: $1,234.56\n"


@pytest.fixture
def folder(tmp_path):
    docs = tmp_path / "docs"
    (docs / "below").mkdir(parents=True)
    (docs / "a.TXT").write_text(INVOICE)
    (docs / "b.md").write_bytes("Grüße an alle".encode("latin-1"))
    (docs / "c.csv").write_text("no")
    (docs / "empty.txt").write_text("")
    (docs / "below" / "d.txt").write_text("no")
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>there</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(docs / "e.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (docs / "broken.docx").write_bytes(b"no zip")
    (docs / "torn.pdf").write_bytes(b"no pdf")
    return docs


def pdf_file(*streams, fields=b""):
    """A small PDF: a page for each content stream, every second one deflated."""
    out, objects = b"%PDF-1.4\n", []
    for k, s in enumerate(streams):
        data, how = (zlib.compress(s), b"/Filter /FlateDecode ") if k % 2 else (s, b"")
        objects += [b"<< /Type /Page /Contents %d 0 R >>" % (2 * k + 2), b"<< %s/Length %d >>\nstream\n%s\nendstream" % (how, len(data), data)]
    for k, body in enumerate([*objects, *fields], 1):
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    return out + b"%%EOF"


PAGES = [b"BT (Invoice 9 from the \\(old\\) shop,) Tj T* [(Amount) -20 ( due $7.50)] TJ ET", b"0 0 m 0 9 l 5 5 m 5 9 l BT (scan) Tj ET"]
FIELDS = [b"<< /FT /Tx /T (name) /V (Ann \\(A\\)) >>", b"<< /FT /Btn /T (paid) /Ff 0 /V /Yes >>", b"<< /FT /Btn /T (kind) /Ff 32768 >>"]


def test_pdf_pages(spark, tmp_path):
    class Eyes:
        def page_text(self, content, page):
            return f"page {page} as an image"

    (tmp_path / "a.pdf").write_bytes(pdf_file(*PAGES, fields=FIELDS))
    (tmp_path / "b.PDF").write_bytes(b"nothing")
    found = files.folder(spark, str(tmp_path))
    rows = {(r.source.rsplit("/", 1)[1], r.page): r for r in pdf.documents(pdf.parsed(found, pdf.SimplePdf(), Eyes()), "simple").collect()}
    assert set(rows) == {("a.pdf", 0), ("a.pdf", 1), ("a.pdf", 2), ("b.PDF", None)} and "not a PDF" in rows["b.PDF", None].error
    assert rows["a.pdf", 0].text == "Document Form Fields:\n- Field 'name' (Type: Text, Page: N/A): 'Ann (A)'\n- Field 'paid' (Type: Checkbox, Page: N/A): 'True'\n- Field 'kind' (Type: Radio, Page: N/A): 'None'"
    assert rows["a.pdf", 1].text == "Invoice 9 from the (old) shop,\nAmount due $7.50" and rows["a.pdf", 1].content_extracted == "Text(simple)" and rows["a.pdf", 1].rotated_degrees is None
    assert rows["a.pdf", 2].text == "scan\n\n--- OCR Extracted Text ---\npage 2 as an image\n---" and rows["a.pdf", 2].content_extracted == "Text(OCR), Text(simple)" and rows["a.pdf", 2].rotated_degrees == 90
    class Tables:
        name = "t"

        def read(self, content):
            return pdf.Pdf([pdf.Page("", [[["a", " b\nc "], [None, "d"]]])])

    row = pdf.documents(pdf.parsed(found, Tables()), "t").first()
    assert row.text == "--- Table 1.1 ---\na\tb c\n\td\n---" and row.content_extracted == "Tables(1)"


def test_pdf_pages_go_by_the_page_tree():
    def read(*objects):
        return pdf.SimplePdf().read(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects))

    def text(k, shown):
        return (k, b"<< /Length 9 >>\nstream\nBT (%s) Tj ET\nendstream" % shown)

    page = lambda k, contents, parent=2: (k, b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R >>" % (parent, contents))
    tree = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [5 0 R 9 0 R 3 0 R] /Count 4 >>"), (9, b"<< /Type /Pages /Parent 2 0 R /Kids [7 0 R 4 0 R 2 0 R] >>")]
    found = read(*tree, page(3, 13), page(4, 14, 9), page(5, 15), page(7, 17, 9), text(13, b"last"), text(14, b"third"), text(15, b"first"), text(17, b"second"))
    assert [p.text for p in found.pages] == ["first", "second", "third", "last"]
    assert [p.text for p in read(*tree[1:], page(3, 13), page(5, 15), text(13, b"b"), text(15, b"a")).pages] == ["a", "b"]
    assert [p.text for p in read(page(3, 13), page(5, 15), text(13, b"a"), text(15, b"b")).pages] == ["a", "b"]
    with pytest.raises(ValueError, match="no page"):
        read((1, b"<< /Type /ObjStm /N 5 >>\nstream\nxx\nendstream"))


def test_model_is_asked_once_for_each_document(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for k in range(10):
        (tmp_path / "docs" / f"{k}.txt").write_text(INVOICE.replace("7", str(k)))
    path, log = str(tmp_path / "store"), tmp_path / "calls"
    log.mkdir()

    class Counting:
        def generate(self, prompt, schema=None):
            (log / uuid.uuid4().hex).write_text("")
            if "Invoice 3" in prompt:
                raise RuntimeError("gone")
            return json.dumps({"is_bill": "Invoice 4" not in prompt, "vendor": "A", "category": "", "total_due": "", "due_date": "", "issue_date": ""})

    app.index(spark, str(tmp_path / "docs"), path, providers.HashedEmbedder())
    rows = app.scan_bills(spark, path, Counting()).collect()
    assert len(list(log.iterdir())) == 10 and len(rows) == 9 and [r.error for r in rows if r.id is None] == ["RuntimeError: gone"]


def test_cascade_of_chunkers(spark):
    def broken(text):
        raise ValueError("no")

    rows = spark.createDataFrame([(1, "one two", "x"), (2, " ", "y"), (3, None, "z")], "doc_id int, text string, source string")
    got = chunking.cascade(rows, [("a", broken), ("b", lambda t: []), ("c", str.split)]).collect()
    assert [(r.doc_id, r.source, r.chunk_index, r.page_content, r.split_method) for r in got] == [(1, "x", 0, "one", "c"), (1, "x", 1, "two", "c")]
    assert chunking.cascade(rows, [("a", broken)]).count() == 0
    assert chunking.pooled([[[1, 2], [3, 4], [9, 9]]], [[1, 1, 0]]).tolist() == [[2, 3]]


def test_store_splits_a_large_source_and_keeps_its_buckets(spark, tmp_path):
    chunks = spark.range(3000).selectExpr("if(id < 2000, 'big', concat('s', id)) AS source", "cast(id as int) AS chunk_index", "'t' AS page_content")
    # Small parts are joined again otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store.build(chunks, str(tmp_path / "s"), buckets=4, file_bytes=2000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.read(spark, str(tmp_path / "s")).count() == 3000 and store.read(spark, str(tmp_path / "s"), "big").count() == 2000
    assert store.read(spark, str(tmp_path / "s"), "big").select(F.input_file_name()).distinct().count() > 1


def test_totals_of_odd_amounts(spark):
    rows = spark.createDataFrame([(True, "a", 1e20, "2025-01-01"), (True, "a", -0.1, None), (True, "b", 1e300, "x"), (True, "b", 0.2, "2025-01-01"), (True, "c", 0.1, "2025-01-01"), (True, "c", 0.2, "2025-02-30"), (True, "d", None, ""), (False, "e", 5.0, "2025-01-01")], "is_bill boolean, category string, amount double, due_date string")
    got = {r.category: r.total for r in bills.category_totals(rows).collect()}
    assert got == {"a": 1e20, "b": 1e300, "c": 0.3} and {r.state: (r.total, r.bills) for r in bills.due_totals(rows, "2025-01-01").collect()} == {"upcoming": (1e20 + 0.3, 3)}


def test_folder(spark, folder):
    found = files.folder(spark, str(folder))
    assert [(r.name, r.type) for r in files.listing(files.names(spark, str(folder))).collect()] == [("a.TXT", "txt"), ("b.md", "md"), ("broken.docx", "doc"), ("e.docx", "doc"), ("empty.txt", "txt"), ("torn.pdf", "pdf")]
    texts = {r.source.rsplit("/", 1)[1]: r for r in files.texts(found).collect()}
    assert texts["b.md"].text == "Grüße an alle" and texts["b.md"].encoding == "latin-1" and texts["a.TXT"].encoding == "utf-8" and "empty.txt" not in texts
    docx = {r.source.rsplit("/", 1)[1]: r for r in files.docx(found).collect()}
    assert docx["e.docx"].text == "Hello\tthere" and docx["broken.docx"].error


def test_index_ask_and_scan(spark, folder, tmp_path):
    path = str(tmp_path / "store")
    embedder = providers.HashedEmbedder()
    assert app.index(spark, str(folder), path, embedder)
    answer = app.ask(spark, path, "Grüße", embedder, providers.EchoGenerator(), 2).first()
    assert len(answer.sources) == 2 and answer.error is None
    summary = app.insights(spark, path, providers.EchoGenerator())
    assert summary["document_count"] == 3 and sorted(r.name for r in summary["documents"].collect()) == ["a.TXT", "b.md", "e.docx"] and summary["entity_source"] in ("llm", "heuristic")

    class Clerk:
        def generate(self, prompt, schema=None):
            options = schema["properties"]
            return json.dumps({"is_bill": True, "vendor": " ", "category": "Nope", "total_due": options["total_due"]["enum"][0], "due_date": "never", "issue_date": ""})

    class Broken:
        def generate(self, prompt, schema=None):
            raise RuntimeError("gone")

    record = app.scan_bills(spark, path, Clerk()).first()
    assert record.vendor == "Unknown" and record.category == "Other" and record.amount == 1234.56 and record.amount_confident
    assert record.due_date is None and record.due_date_raw == "never" and not record.due_date_confident and record.issue_date_raw is None
    assert {(r.source.rsplit("/", 1)[1], r.error.split(":")[0]) for r in store.errors(spark, path).collect()} == {("broken.docx", "BadZipFile"), ("torn.pdf", "ValueError")}
    failed = app.scan_bills(spark, path, Broken()).first()
    assert failed.id is None and "gone" in failed.error
    assert store.wipe(spark, path) and not store.wipe(spark, path)


def test_records_and_forecast(spark):
    rows = spark.createDataFrame([("a", INVOICE), ("b", "nothing"), ("c", " ")], "source string, text string")
    record = bills.extract(rows).collect()
    assert [(r.source, r.vendor, r.category, r.amount, r.due_date, r.issue_date) for r in record] == [("a", "Acme", "Telecom", 1234.56, "2025-04-03", "2025-03-04")]
    made = bills.extract(rows)
    for day, state in (("2025-04-03", "upcoming"), ("2025-03-04", "upcoming"), ("2025-04-04", "past_due"), ("2025-03-03", None)):
        assert [r.state for r in bills.due_totals(made, day).collect()] == ([state] if state else [])


def test_http_generator():
    seen = {}

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.update(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": " hi "}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.handle_request, daemon=True).start()
    model = providers.generator("http", model="m", base_url=f"http://127.0.0.1:{server.server_port}")
    assert model.generate("p", {"type": "object"}) == "hi" and seen["think"] is False and seen["stream"] is False and seen["format"] == {"type": "object"}
    server.server_close()
    with pytest.raises(RuntimeError):
        model.generate("p")
    with pytest.raises(ValueError):
        providers.generator("other")


def test_chat_generator():
    seen = {}

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.update(json.loads(self.rfile.read(int(self.headers["Content-Length"]))), key=self.headers["Authorization"], path=self.path)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": " hi "}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.handle_request, daemon=True).start()
    model = providers.generator("chat", model="m", key="k", base_url=f"http://127.0.0.1:{server.server_port}", timeout=5, temperature=0.1, most_tokens=9)
    assert model.generate("p", {"type": "object"}) == "hi" and seen["key"] == "Bearer k" and seen["path"] == "/chat/completions" and seen["messages"] == [{"role": "user", "content": "p"}]
    server.server_close()
    with pytest.raises(RuntimeError):
        model.generate("p")
    with pytest.raises(ValueError):
        providers.generator("chat", model="m", key="", base_url="", timeout=5, temperature=0.1, most_tokens=9).generate("p")


def test_stream_is_as_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, INVOICE), (2, "TITLE\nx"), (3, None)], "doc_id int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.analysed(ingest.documents(spark, str(tmp_path / "in"), "doc_id int, text string"))
    ingest.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    key = lambda r: (r.doc_id, str(r))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key) == sorted(ingest.analysed(rows).collect(), key=key)


def test_docx_reader():
    with pytest.raises(zipfile.BadZipFile):
        files.docx_text(io.BytesIO(b"x").getvalue())


def test_distance_between_places(spark):
    row = spark.sql("select 1.0D a, 2.0D b, 4.0D c, 6.0D d, cast(null as double) e")
    assert row.select(pdf.distance(F.col("a"), F.col("b"), F.col("c"), F.col("d")), pdf.distance(F.col("a"), F.col("a"), F.col("a"), F.col("a")), pdf.distance(F.col("a"), F.col("b"), F.col("e"), F.col("d"))).first()[:] == (5.0, 0.0, None)


def test_model_lists_of_several_hosts(spark):
    table = "NAME ID SIZE\nb:1 x 2 GB\na:1 x\nno colon\nb:1 x 3 GB"
    rows = spark.createDataFrame([("h", table), ("g", "NAME\nb:1 x 5 MB"), ("e", "NAME"), (None, None)], "host string, output string")
    assert [tuple(r) for r in models.model_list(rows, by=("host",)).collect()] == [("g", "b:1", "5 MB"), ("h", "a:1", ""), ("h", "b:1", "3 GB")]
