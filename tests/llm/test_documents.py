"""Surrogates, main text, archives and toxicity on small fixtures."""

import gzip
import html
import io
import re
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import archive, extract, surrogates, toxicity
from paperloom.llm.batches import prepare, utf8
from tests.llm.helpers import LONG, awkward, empty

KEY = b"k"


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


# --- surrogates -----------------------------------------------------------------

LETTER = (
    "Dear Mr. John Smith and Mrs Anna Smith, Herr Jörg Müller; Госпожа Иванова. Call +44 20 7946 0958 or 555-123-4567, "
    "SSN 123-45-6789, GB29NWBK60161331926819, 4111 1111 1111 1111, password=hunter2222, JOHN@ACME.CO.UK, 10.0.0.1, "
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff". Version 1.2.3 of 2020 costs 1234567.'
)


def test_kinds():
    got = {(kind.split("-")[0], form) for _, _, kind, form in surrogates.entities(LETTER)}
    assert got == {
        ("given", "John"), ("family", "Smith"), ("given", "Anna"), ("given", "Jörg"), ("family", "Müller"), ("family", "Иванова"),
        ("phone", "+442079460958"), ("phone", "5551234567"), ("ssn", "123456789"), ("iban", "GB29NWBK60161331926819"),
        ("card", "4111111111111111"), ("key", "hunter2222"), ("email", "john@acme.co.uk"), ("ip", "10.0.0.1"),
        ("hex", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    }


def test_forms_are_kept():
    out = {k: surrogates.rendered(k, LETTER[a:b], surrogates.surrogate(KEY, k, f, 0)) for a, b, k, f in surrogates.entities(LETTER)}
    assert re.fullmatch(r"[A-Z]+@[A-Z]+\.EXAMPLE\.(COM|NET|ORG)", out["email"])
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", out["ssn"]) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", out["card"])
    assert surrogates.luhn(out["card"].replace(" ", "")) and out["card"][0] == "4"
    number = out["iban"][4:] + out["iban"][:4]
    assert out["iban"][:2] == "GB" and int("".join(str(int(c, 36)) for c in number)) % 97 == 1
    assert re.fullmatch(r"[0-9a-f]{40}", out["hex"]) and all(int(x) < 256 for x in out["ip"].split("."))
    assert out["given-m-latin"] in surrogates.GIVEN["latin"]["m"] and out["given-f-latin"] in surrogates.GIVEN["latin"]["f"]
    assert out["family-f-cyrillic"].endswith("ва")


def test_replacement_keeps_entities_apart_and_together(session):
    texts = [LETTER, None, "", "nothing here", "again JOHN@ACME.CO.UK and john@acme.co.uk", LONG, LETTER, *(f"write to user{i}@mail.example.com or 10.{i // 250}.{i % 250}.1" for i in range(300))]
    docs = awkward(session, texts)
    rows = {r["doc_id"]: r for r in surrogates.replaced(docs, KEY).collect()}
    assert len(rows) == len(texts) and rows[0]["text"] == rows[6]["text"]
    assert [rows[i]["text"] for i in (1, 2, 3, 5)] == [None, "", "nothing here", LONG] and rows[3]["n_entities"] == 0
    for _, _, _, form in surrogates.entities(LETTER):
        assert form not in rows[0]["text"]
    new = rows[0]["text"]
    assert new.startswith("Dear Mr. ") and new.endswith(". Version 1.2.3 of 2020 costs 1234567.") and rows[0]["k0"] == "x"
    families = re.match(r"Dear Mr\. \S+ (\S+) and Mrs \S+ (\S+),", new)
    assert families[1] == families[2]  # one name, one surrogate
    upper, lower = re.fullmatch(r"again (\S+) and (\S+)", rows[4]["text"]).groups()
    assert upper.lower() == lower and upper in new
    pairs = [re.fullmatch(r"write to (\S+) or (\S+)", rows[i]["text"]).groups() for i in range(7, len(texts))]
    assert len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == 300
    originals = {f"user{i}@mail.example.com" for i in range(300)} | {f"10.{i // 250}.{i % 250}.1" for i in range(300)}
    assert not originals & {x for p in pairs for x in p}
    assert surrogates.replaced(empty(session), KEY).count() == 0


def test_collisions_are_drawn_again(session):
    # All addresses with one-digit parts but a few: hardly any value is free at first.
    forms = [("ip", f"{a}.{b}.1.1") for a in range(10) for b in range(10)]
    got = surrogates.assigned(session.createDataFrame(forms, "kind string, form string"), KEY).collect()
    values = [r["value"] for r in got]
    assert len(values) == len(set(values)) == 100 and not set(values) & {f for _, f in forms}


# --- main text --------------------------------------------------------------------

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><a href=x>Home</a></header><nav><ul><li>a b c d e</ul></nav>
<div id="main-content"><h1>Head &amp; tail</h1><p>First para with   many words here and more<p>Second <b>bold</b> word &lt;tag&gt;
<script>var x = "<p>no</p>";</script> end<div class="share-buttons">Share this on all sites now</div><blockquote>Quoted text here</blockquote>
<p>Line one<br>line two</p></div><section class="comments"><p>Great article I loved it so much wow really great</p></section>
<aside>Related things to read now and then</aside><form>Subscribe <input></form><footer>Copyright words all here</footer></body></html>"""
WANT = "Head & tail\nFirst para with many words here and more\nSecond bold word <tag> end\nQuoted text here\nLine one line two"


def test_main_text_with_priors():
    w = extract.Weights()
    assert extract.main_text(PAGE, w) == WANT
    assert [extract.main_text(p, w) for p in (None, "", "<p>", "<nav>only menu</nav>")] == ["", "", "", ""]
    assert extract.main_text("just plain text &amp; more", w) == "just plain text & more"
    assert extract.main_text("<p>a<!-- <p>x --><p>b &copy", w) == "a\nb ©"


def test_region_is_the_best_run():
    rng = np.random.default_rng(4)
    for _ in range(200):
        s = rng.integers(-5, 5, rng.integers(0, 12)).astype(float).tolist()
        a, b = extract.region(s)
        best = max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == best


def test_main_text_of_the_given_pages(session):
    pages = session.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = extract.extracted(pages, extract.train(pages)).toDF("page_id", "url", "got").join(pages.select("page_id", "html"), "page_id")
    for r in out.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r["got"] == "\n".join(b for b in blocks if b)
    none = pages.filter("page_id < 0")
    assert extract.extracted(none, extract.train(none)).count() == 0


# --- archives ---------------------------------------------------------------------


def test_zip64_directory():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr(zipfile.ZipInfo("a.txt"), b"hello")
        z.writestr(zipfile.ZipInfo("b.txt"), b"world!")
    raw = plain.getvalue()
    members = archive.directory(io.BytesIO(raw), len(raw))
    assert [(m.name, m.size) for m in members] == [("a.txt", 5), ("b.txt", 6)]
    assert raw[archive.data_start(io.BytesIO(raw), members[1]) :][:6] == b"world!"
    # The same file with ZIP64 fields: sizes and offsets moved to the extra field and the ZIP64 end record.
    end = raw.rfind(archive.END)
    start = struct.unpack("<I", raw[end + 16 : end + 20])[0]
    central = b""
    for m in members:
        name, extra = m.name.encode(), struct.pack("<HHQQQ", 1, 24, m.size, m.packed, m.header)
        central += archive.CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, len(name), len(extra), 0, 0, 0, 0, 2**32 - 1) + name + extra
    record = archive.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 2, 2, len(central), start)
    locator = archive.LOCATOR64 + struct.pack("<IQI", 0, start + len(central), 1)
    big = raw[:start] + central + record + locator + archive.END + struct.pack("<HHHHIIH", 0, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, 2**32 - 1, 0)
    assert archive.directory(io.BytesIO(big), len(big)) == members
    with pytest.raises(ValueError):
        archive.directory(io.BytesIO(b"no archive"), 10)


def test_archive_round_trip(session, tmp_path):
    body = "<p>" + "same body " * 30 + "</p>"
    rows = [(5, "u5", body), (3, "u3", body), (3, "u3", body), (9, None, body), (None, "u", body), (1, "a", "short"), (2, "b", "short"), (4, "c", None), (6, "d", ""), (7, "e", "ünïcode " * 50000)]
    pages = session.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in archive.round_trip(pages).collect()), key=repr)
    n = len(body)
    want = [(5, n, "revisit", 3), (3, n, "response", None), (3, n, "response", None), (9, n, "revisit", 3), (None, n, "revisit", 3), (1, 5, "response", None),
            (2, 5, "response", None), (4, 0, "response", None), (6, 0, "response", None), (7, len("ünïcode ".encode()) * 50000, "response", None)]
    assert got == sorted(want, key=repr)
    archives = archive.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=300)
    assert archives.count() > 1  # full archives are closed
    index = archive.record_index(archives)
    assert index.count() == len(rows)
    one = archive.read_records(index.filter("page_id = 7")).collect()  # a range read of one record
    assert len(one) == 1 and bytes(one[0]["payload"]).decode() == rows[9][2] and one[0]["url"] == "e"
    path = archives.first()["path"].removeprefix("file://")
    with zipfile.ZipFile(path) as z:  # other readers agree
        data = gzip.decompress(z.read(archive.WARC_MEMBER))
        assert data.startswith(b"WARC/1.1\r\n") and z.testzip() is None
    assert archive.round_trip(pages.filter("page_id < 0")).count() == 0


# --- toxicity -----------------------------------------------------------------------


def gradient_check(names):
    rng = np.random.default_rng(0)
    net = toxicity.new_net(1)
    w = toxicity.joined(["one two three four five six", "seven eight one two nine"])
    _, first, count = toxicity.windows(w.row, 2)
    target, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])
    ones = np.ones(len(w.word), np.float32), np.ones(len(w.grams), np.float32)

    def loss():
        p = 1 / (1 + np.exp(-toxicity.window_logits(net, w, first, count).astype(float)))
        return float(-(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() / weight.sum())

    g, dx = toxicity.gradients(net, w, first, count, target, weight, *ones)
    for n in names:
        at = tuple(rng.integers(0, s) for s in net[n].shape)
        keep = net[n][at]
        net[n][at] = keep + 1e-2
        up = loss()
        net[n][at] = keep - 1e-2
        down = loss()
        net[n][at] = keep
        assert abs((up - down) / 2e-2 - g[n][at]) < 2e-3, n
    return dx


def test_gradients_through_time():
    for _ in range(3):
        gradient_check(["Wf", "Uf", "cf", "Wb", "Ub", "cb", "A", "a", "v", "o", "d"])


def test_windows_cover_texts():
    row = np.repeat([0, 2, 3], [1, 32, 75])
    text, first, count = toxicity.windows(row, 4)
    assert text.tolist() == [0, 2, 3, 3, 3, 3] and count.tolist() == [1, 32, 32, 32, 32, 32]
    assert first.tolist() == [0, 1, 33, 49, 65, 76]  # the last window ends with its text


def test_learns_words_and_endings(session):
    rng = np.random.default_rng(2)
    plain = ["river", "stone", "market", "cloud", "garden", "window", "letter", "paper", "silver", "bridge"]
    stem = [a + b for a in ("grubz", "vlark") for b in ("en", "ung", "o", "ar", "ist", "um")]
    docs = []
    for i in range(400):
        words = [plain[k] for k in rng.integers(0, 10, rng.integers(5, 120))]
        if i % 4 == 0:
            words[rng.integers(0, len(words))] = stem[rng.integers(0, 12)]
        docs.append((i, " ".join(words), int(i % 4 == 0)))
    df = session.createDataFrame(docs, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").unionByName(session.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    import pyspark.sql.functions as F

    model = toxicity.fit(df, labels, F.col("doc_id") < 300)
    rows = toxicity.scored(df, model).collect()
    wrong = [r for r in rows if (r["score"] >= toxicity.THRESHOLD) != (r["toxic"] == 1) and r["doc_id"] >= 300]
    assert len(wrong) <= 2
    # The window that holds the word decides, wherever it lies in a long text.
    far = " ".join(plain * 3000)
    scores = toxicity.scores(*utf8(pa.array([far, far + " grubzung", None, " ", "?!"])), model)
    assert scores[1] > 0.5 > scores[0] and scores[2] == scores[3] == scores[4] == model.prior
    kept = toxicity.without_toxic(awkward(session, [None, "", "river cloud paper", "river grubzum stone", "?!"]), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 4] and kept.columns == awkward(session, []).columns
    assert toxicity.scored(empty(session), model).count() == 0


def test_nothing_to_learn(session):
    model = toxicity.train(["a b", "c"], np.array([0, 0]), 0.2)
    assert toxicity.scores(*utf8(pa.array(["a", None])), model) == pytest.approx([0.2, 0.2])
    assert toxicity.train([], np.zeros(0), 0.0).prior > 0


def test_crc_rule(session):
    from paperloom.llm.batches import crc_bucket
    from pyspark.sql import functions as F

    df = session.createDataFrame([(i,) for i in (0, 7, 123456789)], "doc_id long")
    assert [r[0] for r in df.select(crc_bucket(F.col("doc_id"), 3)).collect()] == [zlib.crc32(str(i).encode()) % 3 for i in (0, 7, 123456789)]
