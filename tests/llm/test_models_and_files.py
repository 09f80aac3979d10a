"""Taggers, classifiers, votes, archives, token files and segmentation on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from quitanda.llm import merge_dropout, pii, quality_votes, queries, token_files, toxicity, units, url_reputation, warc_zst
from quitanda.llm import units as stretches
from quitanda.llm.common import arrow_bytes, mix, word_hashes
from quitanda.session import scratch_path

SF = "/root/testdata/sf0.01"
WORDS_FILE = str(public_tokenizers.path("word_bpe_49k.json"))


# --- personal data --------------------------------------------------------------------------------

def luhn_ok(digits):
    odd = [int(d) for d in digits[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0


def plain_spans(text):
    """The patterns as stated, one search each."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 13 <= len(digits(m[0])) <= 19 and luhn_ok(digits(m[0]))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_patterns_equal_plain_search():
    rng = random.Random(1)
    for _ in range(6000):
        text = "".join(rng.choices("a1@.-+ (%é4", k=rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("a@b@c.d", "x..@a.b.c@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (988) 555-2485", "300.1.1.1 001.002.003.004"):
        assert pii.base_spans(text) == plain_spans(text)


def test_patterns_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "@" * 300_000):
        pii.base_spans(text)


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(0)
    model = pii.Tagger(hidden=3)
    codes, tags = rng.integers(0, 128, (4, 7)), np.zeros((4, 7), int)
    tags[:, 2], tags[:, 3:5] = 1, 2
    _, grads = model.loss_and_grads(codes, tags)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        at = int(np.abs(grads[name].reshape(-1)).argmax())
        old = flat[at]
        flat[at] = old + 1e-5
        up = model.loss_and_grads(codes, tags)[0]
        flat[at] = old - 1e-5
        down = model.loss_and_grads(codes, tags)[0]
        flat[at] = old
        assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_spans_are_found(spark, tagger):
    rng = random.Random(4)
    hit = total = wrong = 0
    for _ in range(120):
        name = "".join(rng.choices("abcdefghkmoprs", k=rng.randint(4, 8)))
        mail = f"{name}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com"
        address = ".".join(str(rng.randint(10, 250)) for _ in range(4))
        value, kind = rng.choice([(mail, 0), (address, 1), (f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", 3)])
        text = f"thshan onble erth {value} inhe that eredst"
        found = pii.decode(tagger, [text])[0]
        total += 1
        hit += (kind, 18, 18 + len(value)) in found
        wrong += sum(s != (kind, 18, 18 + len(value)) for s in found)
    assert hit >= 0.85 * total and wrong <= 0.25 * total, (hit, wrong, total)


def test_sample_has_every_kind_and_each_text_once(spark, rows):
    copies = ["one of many: me.42@mail3.example.com"] * 1000
    cards = [f"{i} card 4111 1111 1111 1111 here" for i in range(6)]
    ips = [f"{i} from 12.34.56.78" for i in range(6)] + ["7 " + "x" * 600 + (" 1" + "y" * 600) * 50 + " at 12.34.56.79"]
    df = rows([(t,) for t in copies + cards + ips + ["no span 12", "", None]], "text string")
    got = pii.training_sample(df)
    assert sum("one of many" in p for p, _ in got) == 1
    assert [sum(k == kind for _, own in got for k, _, _ in own) for kind in range(4)] == [1, 7, 6, 0]
    few = pii.training_sample(df, rows=5)
    assert {k for _, own in few for k, _, _ in own} == {0, 1, 2}
    assert pii.fit(df.filter("not contains(text, '@')"), steps=1) is not None
    assert pii.fit(df.filter("text like 'no span%'"), steps=1) is None


def test_added_spans_leave_the_base_alone(tagger):
    text = "call 00" + "1 (988) 555-2485 or me.42@mail3.example.com and 12.34.56.78"
    base = pii.base_spans(text)
    both = pii.add_spans(base, pii.decode(tagger, [text])[0], text)
    assert set(base) <= set(both)
    spots = sorted((a, b) for _, a, b in both)
    assert all(x[1] <= y[0] for x, y in zip(spots, spots[1:]))


def test_long_stretch_decodes_as_one(tagger):
    text = "word 12.34.56.78 " * 400
    found = pii.decode(tagger, [text])[0]
    assert found == sorted(found, key=lambda s: s[1]) and all(0 <= a < b <= len(text) for _, a, b in found)


def test_find_pii_rows(spark, rows, tagger):
    data = [(1, "é me.42@mail3.example.com"), (1, "é me.42@mail3.example.com"), (2, None), (3, ""), (None, "12.34.56.78"),
            (4, "x" * 150_000 + " +1 (988) 555-2485")]
    df = rows([(*d, "z") for d in data], "doc_id long, text string, spans string")
    got = sorted(((r["doc_id"], [tuple(s) for s in r["base"]]) for r in pii.find_pii(df, tagger).collect()), key=repr)
    want = sorted(((i, [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t or "")]) for i, t in data), key=repr)
    assert got == want
    assert pii.find_pii(df.limit(0), None).collect() == []
    assert pii.fit(df.limit(0)) is None
    red = pii.find_pii(df.filter("doc_id = 1").limit(1), None).crossJoin(rows([("é me.42@mail3.example.com",)], "t string"))
    assert red.select(pii.redact(F.col("t"), F.col("spans"))).first()[0] == "é [email]"


def test_query_hash_equals_plain_spans(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.personal_data(spark, SF).collect():
        spans = plain_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.span_text(spans).encode()).hexdigest()
        assert r["n_email"] == sum(k == 0 for k, *_ in spans) and r["n_phone"] == sum(k == 3 for k, *_ in spans)
        assert set(filter(None, pii.span_text(spans).split(","))) <= set(r["spans"].split(","))


# --- toxicity -------------------------------------------------------------------------------------

def test_toxic_texts_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    held = labels.filter("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, chain).join(held, "doc_id").collect()
    right = sum(r["rejected"] == bool(r["label"]) for r in scored)
    clean = [r for r in scored if not r["label"]]
    assert right >= 0.93 * len(scored) and sum(r["rejected"] for r in clean) <= 0.02 * len(clean)


def test_later_links_use_earlier_probabilities():
    rng = np.random.default_rng(2)
    x = (rng.random((600, 6)) < 0.3).astype(float)
    first = x[:, 0]
    chain = toxicity.train_chain(np.arange(6), x[:, 1:], np.stack([first, first], 1))
    assert len(chain.weights[0]) == 6 and len(chain.weights[1]) == 7
    chain = toxicity.train_chain(np.arange(6), x, np.stack([first, np.minimum(1, first + x[:, 1])], 1))
    assert chain.weights[1][6] > 0 and ((chain.predict(x)[:, 1] > 0.5) == ((x[:, 0] + x[:, 1]) > 0)).mean() > 0.99


def test_toxicity_edges(spark, rows):
    docs = rows([(i, f"stupid word{i} idiot" if i % 3 == 0 else f"fine word{i} day", 1) for i in range(90)]
                + [(100, None, 1), (101, "", 1), (None, "stupid idiot", 1), (3, "fine day", 1)], "doc_id long, text string, toxic int")
    labels = rows([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels)
    got = {(r["doc_id"], r["rejected"]) for r in toxicity.score(docs, chain).collect()}
    assert (None, True) in got and (100, False) in got and (101, False) in got and (3, True) in got and (1, False) in got
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == docs.count() - sum(r[1] for r in [
        (r["doc_id"], r["rejected"]) for r in toxicity.score(docs, chain).collect()])
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.drop_toxic(docs, None).count() == docs.count()
    assert not any(r["rejected"] for r in toxicity.score(docs, None).collect())
    assert toxicity.score(docs.limit(0), chain).collect() == []


# --- url reputation -------------------------------------------------------------------------------

def test_url_parts_and_rules(spark, rows):
    urls = ["http://WWW.Example.com/en/x?q", "https://a.example.com/en/", "http://example.com/de/", "http://example.com",
            "ftp://notexample.com/en/", "x://foo.net/es/1", "x://foo.net/fr", "x://net/fr/", None, "no scheme", "a://b://c/d", "http://?x", ""]
    got = {r["page_id"]: r for r in url_reputation.judge(
        rows(list(enumerate(urls)), "page_id int, url string"), rows([], "page_id int, bad int")).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == [
        "www.example.com/en/", "example.com/en/", "com/", None, "com/", "net/es/", None, "net/fr/", None, None, None, None, None]
    assert [got[i]["host"] for i in range(len(urls))] == ["www.example.com", "a.example.com", "example.com", "example.com",
                                                         "notexample.com", "foo.net", "foo.net", "net", "", "", "b:", "", ""]
    assert got[0]["path"] == "/en/x" and got[10]["path"] == "//c/d" and got[0]["verdict"] == "allow" and got[1]["verdict"] == "block"


def test_only_enough_bad_pages_block_a_host(spark, rows):
    pages = [(i, f"http://bad.site.org/{i}", "q") for i in range(60)] + [(100 + i, f"http://good{i % 5}.org/{i}", "q") for i in range(100)]
    pages += [(300, "http://one.org/x", "q"), (301, "http://bad.site.org/new", "q"), (301, "http://bad.site.org/new", "q"), (None, "http://bad.site.org/", "q")]
    bad = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(100)] + [(300, 1), (300, None), (None, 1)]
    got = url_reputation.judge(rows(pages, "page_id int, url string, host string"), rows(bad, "page_id int, bad int"))
    verdicts = Counter((r["host"], r["verdict"]) for r in got.collect())
    assert verdicts["bad.site.org", "block"] == 63 and ("bad.site.org", "allow") not in verdicts
    assert verdicts["one.org", "allow"] == 1 and got.count() == len(pages)
    assert url_reputation.judge(rows([], "page_id int, url string"), rows([], "page_id int, bad int")).collect() == []


# --- WARC -----------------------------------------------------------------------------------------

def test_archive_round_trip(spark, rows):
    big = "<p>" + "long text " * 200_000
    pages = [(i, f"http://h/{i}", f"<html><body>page {i % 40} with some words in it</body></html>", "z") for i in range(300)]
    pages += [(900, None, None, "z"), (901, "u\r\nv", "", "z"), (902, "é", "é", "z"), (903, "b", big, "z"), (904, "b", big, "z"),
              (None, "n", "only null", "z"), (None, "n", "é", "z"), (7, "again", pages[7][2], "z")]
    read = warc_zst.archive(rows(pages, "page_id long, url string, html string, payload string"), scratch_path(spark, "warc")).collect()
    first = {}
    for i, _, html, _ in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = Counter()
    for i, _, html, _ in pages:
        payload = (html or "").encode()
        to = first.get(html or "")
        to = None if to == i or to is None else to
        want[i, len(payload), warc_zst.digest(payload), "response" if to is None else "revisit", to] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read) == want
    assert all(warc_zst.digest(bytes(r["payload"])) == r["payload_digest"] for r in read if r["record_type"] == "response")
    assert warc_zst.archive(rows([], "page_id long, url string, html string"), scratch_path(spark, "warc")).collect() == []


def test_archives_are_cut_alike_again_and_stray_files_are_not_read(spark, rows, tmp_path):
    pages = rows([(i, f"http://h/{i}", f"page {i % 90}") for i in range(200)], "page_id long, url string, html string")
    planned, cut = warc_zst.plan_records(pages), []
    for name, order in (("a", "url"), ("b", "refers_to")):
        written = warc_zst.write_archives(planned.coalesce(1).sortWithinPartitions(order), str(tmp_path / name))
        assert written.count() == 1
        cut.append({f.name: f.read_bytes() for f in (tmp_path / name).glob("*.zst")})
    assert cut[0] and cut[0] == cut[1]
    again = scratch_path(spark, "warc")
    first = {(r.page_id, r.refers_to) for r in warc_zst.archive(pages, again).collect()}
    fs, root = warc_zst.filesystem(again)
    with fs.open_output_stream(f"{root}/pages-999999-00000.warc.zst", compression=None) as stray:
        stray.write(warc_zst.encode_file([warc_zst.build_record(5, "u", b"lost attempt", None, "t")]))
    read = warc_zst.archive(pages, again).collect()
    assert len(read) == 200 and {(r.page_id, r.refers_to) for r in read} == first


def test_outcomes_are_counted_once(spark, rows):
    outcomes = rows([(f"h{i % 7}.d{i % 3}.com", i % 2) for i in range(60)], "host string, bad int")
    seen = url_reputation.reputation(outcomes)
    assert seen.count() == 21 and any("host-outcomes" in f for f in seen.inputFiles())
    assert "LocalTableScan" not in seen._jdf.queryExecution().executedPlan().toString()


def test_archive_frames_stand_alone():
    records = [warc_zst.build_record(i, f"http://h/{i}", f"body {i % 9} of a page, quite like the others".encode() * 9, None, "t") for i in range(400)]
    blob = warc_zst.encode_file(records)
    assert list(warc_zst.decode_file(blob)) == records and len(blob) < sum(map(len, records)) / 2
    size = int.from_bytes(blob[4:8], "little")
    assert int.from_bytes(blob[:4], "little") == 0x184D2A5D
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(blob[8:8 + size]))
    one = reader.decompressobj()
    assert one.decompress(blob[8 + size:]) == records[0] and one.unused_data
    assert list(warc_zst.decode_file(warc_zst.encode_file(records[:1]))) == records[:1]


# --- token files ----------------------------------------------------------------------------------

def test_numbers_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = rng.integers(0, 2 ** rng.integers(1, 33, n), dtype=np.uint64).astype(np.uint32)
        control, data = token_files.pack(v)
        assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == v).all()
    ids = rng.zipf(1.3, 5000) % 40_000
    blob = token_files.encode_file([3, None], np.array([2000, 3000]), ids.astype(np.uint32))
    names, counts, back = token_files.decode_file(blob)
    assert names == [3, None] and counts.tolist() == [2000, 3000] and (back == ids).all() and len(blob) < 4 * len(ids)


def reference_ids(texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(WORDS_FILE)
    return [e.ids for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["", " ", "A  b\n\nC", "don't I'LL we've", "é e\u0301 \u0301x \u0344", "a\u00a0b\u2003c\td\re\x0bf\x0cg\x1ch\x85i", "<|endoftext|> x<|startoftext|>",
       "日本語 テスト 12345", "ΑΣ ΣΑΣ Σ", "İi ǅ ﬁ", "a\u200db \ufeff z", "x" * 3000, "A.B, C., D,. E.\n'S, don'T. I'LL, 1. 2, é, ñ. x.", "<|ENDOFTEXT|> A, b.", "ok, <|endoftext|>, ok.", "🙂🙂👩\u200d👩 ok", "A\u030a\u0301 \u1100\u1161\u11a8"]


def test_words_encode_like_whole_texts():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("aBS'té\u0301 \n\t.,.,1!Ω\u0345\u00a0-", k=rng.randint(0, 60))) for _ in range(400)]
    encoder = token_files.encoder_of(WORDS_FILE)
    want = reference_ids(texts)
    for tool in (encoder, token_files.WordEncoder(encoder.tokenizer, limit=40)):  # the second forgets on the way
        for lo in (0, 200):
            sizes, flat = tool.encode([t.encode() for t in texts[lo:]])
            ends = np.cumsum(sizes)
            assert [flat[e - s:e].tolist() for s, e in zip(sizes, ends)] == want[lo:]


def test_long_texts_are_cut_where_words_end(monkeypatch):
    monkeypatch.setattr(units, "STRETCH", 50)
    texts = ["word another. " * 40, "x" * 200, "short", "<|endoftext|> " * 30, "a, b.\n" * 30 + "y" * 90 + " end."]
    sizes, flat = token_files.encoder_of(WORDS_FILE).encode([t.encode() for t in texts])
    ends = np.cumsum(sizes)
    assert [flat[e - s:e].tolist() for s, e in zip(sizes, ends)] == reference_ids(texts)


def test_token_file_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    start, want = 0, []
    for (doc, _), ids in zip(docs, reference_ids([t for _, t in docs])):
        ids = ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in queries.ranked_ids(spark, SF).orderBy("doc_id").collect()] == want


def test_token_file_edges(spark, rows, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 50)
    data = [(5, "five words stand in here"), (5, "another row"), (1, None), (2, ""), (None, "no id"), (9, "long " * 30_000)]
    df = rows([(*d, 1) for d in data], "doc_id long, text string, ids int")
    got = token_files.token_files(df, scratch_path(spark, "tokens"), WORDS_FILE).collect()
    want = Counter((i, tuple([*ids, 2])) for (i, _), ids in zip(data, reference_ids([t for _, t in data])))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    placed = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in placed] == [1, 2, 5, 5, 9, None]
    assert all(a["start"] + len(a["ids"]) == b["start"] for a, b in zip(placed, placed[1:]))
    assert token_files.token_files(df.limit(0), scratch_path(spark, "tokens"), WORDS_FILE).collect() == []


# --- quality --------------------------------------------------------------------------------------

def plain_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_counts_equal_plain_code():
    rng = random.Random(6)
    texts = [None, "", " \n ", "a", "a b", "a b a b a b", "é é é é", "\x1c a\x85b"]
    texts += ["".join(rng.choices("ab# \n\té|", k=rng.randint(0, 60))) for _ in range(1500)]
    column = pa.array(texts, pa.string())
    for t, raw, words in zip(texts, arrow_bytes(column), word_hashes(column, lower=False)):
        assert quality_votes.measure(raw, words)[:5] == plain_measure(t), repr(t)


def test_words_hash_alike_wherever_they_stand():
    texts = ["Aa bb\taa  é É", None, "", " bb", "\x1cbb", "x" * 3_000_000 + " bb", "aA", "é"]
    got = word_hashes(pa.array(texts, pa.string()), lower=True)
    assert [len(g) for g in got] == [5, 0, 0, 1, 1, 2, 1, 1]
    assert got[0][0] == got[0][2] == got[6][0] != got[0][1] == got[3][0] == got[5][1] and got[0][3] == got[7][0] != got[0][4]
    assert got[4][0] != got[3][0]
    part = word_hashes(pa.array(texts, pa.string())[3:], lower=True)
    assert [p.tolist() for p in part] == [g.tolist() for g in got[3:]]
    assert word_hashes(pa.array(["A a"]), lower=False)[0][0] != word_hashes(pa.array(["A a"]), lower=False)[0][1]
    assert word_hashes(pa.array([], pa.string()), lower=True) == []


def test_em_finds_who_is_right():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.5
    votes = np.zeros((4000, 5), int)
    for r, accuracy in enumerate((0.95, 0.9, 0.85, 0.6, 0.55)):
        right = rng.random(4000) < accuracy
        votes[:, r] = np.where(rng.random(4000) < 0.2, 0, np.where(right == truth, 1, -1))
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, held = quality_votes.fit_votes(patterns, counts.astype(float))
    p = posterior[index.reshape(-1)]
    assert ((p > 0.5) == truth).mean() > ((votes.sum(1) > 0) == truth).mean() + 0.01
    assert list(held) == sorted(held, reverse=True) and held[0] > 0.9 > 0.65 > held[3]


def test_quality_keeps_most_good_texts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.weak_supervision(spark, SF).join(labels, "doc_id").collect()
    long = [r for r in got if not r["base_failed"]]
    good, bad = [r for r in long if r["quality"]], [r for r in got if not r["quality"]]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def test_quality_edges(spark, rows):
    data = [(1, None), (2, ""), (None, "some words " * 30), (3, "x " * 100_000), (3, "x " * 100_000)]
    got = quality_votes.judge(rows([(*d, 1) for d in data], "doc_id long, text string, n_words int")).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in quality_votes.COUNTS[:5])) for r in got), key=repr) == sorted(
        ((i, *plain_measure(t)) for i, t in data), key=repr)
    assert all(r["base_failed"] and not r["kept"] for r in got)
    assert quality_votes.judge(rows([], "doc_id long, text string")).collect() == []


# --- segmentation ---------------------------------------------------------------------------------

PIECES = ["", " ", "  two  blanks  ", "a\n\nb \n c", "tab\tand\rreturn", "literal ▁ mark▁▁", "日本語 🙂 é \x00", "word" * 400, "loneliness of the long", "▁", "\n"]


@pytest.fixture(scope="module")
def model():
    return queries.dropout_model()


def test_no_dropout_is_the_librarys_own_segmentation(spark, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    tool = merge_dropout.Segmenter(model, 0, 0.0)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts + [p for p in PIECES if "▁" not in p and "\x00" not in p]:
        assert tool.encode(t).tolist() == library.encode(t), t[:80]


def test_dropout_varies_and_loses_nothing(model):
    rng = random.Random(8)
    texts = PIECES + ["".join(rng.choices("ab ▁\n.é日", k=rng.randint(0, 50))) for _ in range(500)]
    tools = [merge_dropout.Segmenter(model, s, 0.3) for s in (1, 2)]
    assert all(tool.decode(tool.encode(t).tolist()) == t for tool in tools for t in texts)
    text = "the thundering loneliness of distance running " * 20
    again = merge_dropout.Segmenter(model, 1, 0.3)
    assert tools[0].encode(text).tolist() == again.encode(text).tolist() != tools[1].encode(text).tolist()
    assert len({tuple(tools[0].encode(f"thundering loneliness {i}").tolist()[:-3]) for i in range(8)}) > 3
    assert len(tools[0].encode(text)) > len(merge_dropout.Segmenter(model, 1, 0.0).encode(text))


def test_every_occurrence_draws_its_own_dropout(model, monkeypatch):
    tool = merge_dropout.Segmenter(model, 3, 0.1)
    texts = [f"{i}\nunder the international thundering ▁ 日本語 {'word' * 30}" for i in range(150)] + PIECES + [" again" * 900]
    units = [re.findall(r" *[^ \n]+|\n| +", " " + t) if t else [] for t in texts]
    flat = [u for us in units for u in us]
    own = [xxhash.xxh3_64_intdigest(t.encode(), seed=3) for t in texts]
    places = [(o, n) for o, us in zip(own, units) for n in range(len(us))]
    keys = mix(np.array([o for o, _ in places], np.uint64) + np.array([n for _, n in places], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    each = [tool.pieces.unit_ids(u, int(k), tool.limit) for u, k in zip(flat, keys)]
    raw = [t.encode() for t in texts]
    for stretch in (1 << 20, 100):
        monkeypatch.setattr(stretches, "STRETCH", stretch)
        counts, ids = tool.encode_many(raw)
        assert ids.tolist() == [i for e in each for i in e] and counts.sum() == len(ids)
        assert counts.tolist() == [sum(len(next(rest)) for _ in us) for rest in [iter(each)] for us in units]
        assert tool.decode_many(counts, ids) == raw
    assert tool.encode_many(raw)[1].tolist() == ids.tolist()  # from what is remembered
    for word, least in ((" international", 10), (" thundering", 10), (" again", 4)):
        assert len({tuple(e) for u, e in zip(flat, each) if u == word}) >= least, word


def test_forms_are_forgotten_without_harm(model):
    tools = [merge_dropout.Segmenter(model, 5, 0.2) for _ in range(2)]
    tools[1].forms.limit = 3
    texts = [f"some words {i % 7} come again and others{i % 5} too {i}".encode() for i in range(60)]
    for lo in range(0, 60, 20):
        one, two = (t.encode_many(texts[lo:lo + 20])[1].tolist() for t in tools)
        assert one == two


def test_segmentation_rows(spark, rows, model):
    data = [(i, t) for i, t in enumerate(PIECES)] + [(None, "x"), (50, None), (1, PIECES[1]), (60, "many words " * 20_000)]
    got = merge_dropout.checked(rows([(*d, [1]) for d in data], "doc_id long, text string, ids array<int>"), model).collect()
    assert len(got) == len(data) and all(r["lossless"] for r in got)
    assert merge_dropout.checked(rows([], "doc_id long, text string"), model).collect() == []
