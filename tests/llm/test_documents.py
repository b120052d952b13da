"""Problems 8, 9 and 10."""

import random

import pytest

from tidewrack.llm import leaks, shared_spans
from tidewrack.llm import tokenize as T

VOCABULARY = f"{T.FOLDER}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(7)
    return ["".join(rnd.choice("abcdefghijklmnoprstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(3000)]


def library():
    """The public library's encoder of the same vocabulary, which only tests use."""
    import tiktoken

    return tiktoken.Encoding("reference", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(VOCABULARY), special_tokens={})


def test_piece_stream_equals_whole_pieces():
    enc = library()
    stream = T.PieceStream(T.load(VOCABULARY))
    rnd = random.Random(0)
    for alphabet in ("ab", "aeiouthnrs", "-=", "กาม่อน", "0123456789", " ", "中文字はのディー、。"):
        for n in (1, 7, 300, 1200):
            w = "".join(rnd.choice(alphabet) for _ in range(n)).encode()
            assert stream.feed(w) + stream.finish() == enc._core_bpe.encode_single_piece(w)
            assert not stream.buf and not stream.last


def test_no_merge_crosses_a_closed_seam():
    enc, merges = library(), T.load(VOCABULARY)
    rnd = random.Random(9)
    chars = "กขคงจาิีุูเแไ่้中国人的一はのをディーンサ、。éüñđạự«»—“”az09 "
    closed = 0
    for _ in range(3000):
        w = "".join(rnd.choice(chars) for _ in range(rnd.randint(2, 9)))
        ids, at = enc._core_bpe.encode_single_piece(w.encode()), set()
        for t in ids:
            at.add((max(at) if at else 0) + len(merges.words[t]))
        for k in range(1, len(w)):
            if not merges.open(w[k - 1 : k + 1]):
                closed += 1
                assert len(w[:k].encode()) in at
    assert closed > 1000


def test_encoder_does_without_a_library():
    """Ids of short and long texts, with both libraries that know the vocabulary out of reach, and a buffer far smaller than the text."""
    import subprocess
    import sys

    text = "It's a short text, 你好 สวัสดี. " * 40
    code = f"import sys; sys.modules['tiktoken'] = sys.modules['tokenizers'] = None; from tidewrack.llm import tokenize as T; t = T.Transducer({VOCABULARY!r}); print([t.encode(x).tolist() for x in ({text[:30]!r}, {text!r})])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert len(text) > T.CHUNK and eval(out) == [library().encode_ordinary(x) for x in (text[:30], text)]


def test_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr(T, "KNOWN", 50)
    t, enc, rnd = T.Transducer(VOCABULARY), library(), random.Random(10)
    for _ in range(5):
        text = "".join(rnd.choice("abcdefgh กขคงจ的国人 ") for _ in range(3000)) + "x" * 5000
        out = []
        for i in range(0, len(text), 100):
            out += t.feed(text[i : i + 100])
            assert len(t.rest) <= T.HOLD + 100 and len(t.stream.buf) <= 2 * t.merges.lookahead
        assert out + t.finish() == enc.encode_ordinary(text)
        assert max(map(len, (t.known, t.merges.seams, t.merges.fits))) <= 50
    t.known.clear()


def test_chunks_equal_whole(monkeypatch):
    monkeypatch.setattr(T, "HOLD", 48)
    rnd = random.Random(4)
    t, enc = T.Transducer(VOCABULARY), library()
    bits = [" ", "  ", " " * 200, "a" * 300, "'r", "'re", "'", "'" * 90, "1" * 120, "กำ" * 70, "\n\n", "\n" * 90, "é" * 60, "!?" * 60, "word ", "<|endoftext|>", " ", "　x"]
    for _ in range(150):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 7)))
        out, at = [], 0
        while at < len(text):
            n = rnd.choice([1, 2, 5, 40, 200])
            out += t.feed(text[at : at + n])
            at += n
        out += t.finish()
        assert out == enc.encode_ordinary(text)


def test_ids_and_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["Hello world", "", None, " ", "สวัสดี 你好 <|endoftext|>", "x" * 200_000, "a b " * 60_000, "\x00\x07"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    enc = T.token_ids(df)
    rows = {r.doc_id: r.ids for r in enc.collect()}
    ref = Tokenizer.from_file(f"{T.FOLDER}/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    for k, t in enumerate(texts):
        assert rows[k] == (ref.encode(t, add_special_tokens=False).ids if t else [])
    assert {r.doc_id: r.text for r in T.decoded(enc).collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert T.token_ids(df.limit(0)).count() == 0


def prose(words, rnd, n):
    return " ".join(rnd.choice(words) for _ in range(n))


def test_leaks(spark, words):
    rnd = random.Random(5)
    items = [prose(words, rnd, 60) + f" {k}" for k in range(12)]
    cut = items[0].split()
    altered = items[1].split()
    for k in range(4, 60, 14):
        altered[k] = "altered"
    docs = [
        "Before. " + items[0] + " After.", prose(words, rnd, 80) + " " + " ".join(cut[10:40]).upper().replace(" ", " -- ") + "! " + prose(words, rnd, 30), " ".join(altered), prose(words, rnd, 300), " ".join(cut[:9]) + prose(words, rnd, 100),
        None, "", "  ", items[2] + " " + items[3], " ".join(x if k % 2 else "other" for k, x in enumerate(cut)), "É" * 50 + items[4].replace(" ", "​  "), items[0],
    ]
    df = spark.createDataFrame([(k, d, "x") for k, d in enumerate(docs)], "doc_id bigint, text string, item string")
    it = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, " ")], "item_id bigint, text string")
    want = {(0, 0), (1, 0), (2, 1), (8, 2), (8, 3), (10, 4), (11, 0)}
    rows = leaks.leaks(df, it).collect()
    assert {(r.doc, r.item) for r in rows} == want
    one = next(r for r in rows if (r.doc, r.item) == (0, 0))
    assert docs[0][one.start_pos : one.end_pos].startswith(items[0][:20]) and one.share > 0.95
    # beyond one automaton the same rows come by a join
    key = lambda r: (r.doc, r.item, round(r.share, 9), r.start_pos, r.end_pos)
    assert sorted(map(key, leaks.leaks(df, it, item_chars=900).collect())) == sorted(map(key, rows))
    tiny = spark.createDataFrame([(1, "Ab-c"), (2, "xyzxyz 12345 q")], "item_id bigint, text string")
    few = spark.createDataFrame([(1, "see ABC there"), (2, "xyzxyz12345q and more"), (3, None)], "doc_id bigint, text string")
    assert {(r.doc, r.item) for r in leaks.leaks(few, tiny, item_chars=1).collect()} == {(r.doc, r.item) for r in leaks.leaks(few, tiny).collect()} == {(1, 1), (2, 2)}
    assert leaks.leaks(df.limit(0), it, item_chars=1).count() == 0
    assert leaks.leaks(df.limit(0), it).count() == 0 and leaks.leaks(df, it.limit(0)).count() == 0


def test_equal_texts_are_joined_once(spark, words, monkeypatch):
    """Repeated documents and items come out with rows of their own, but go through nomination and alignment once, and windows outside the items stay behind."""
    rnd = random.Random(9)
    item, other = prose(words, rnd, 60), prose(words, rnd, 500)
    df = spark.createDataFrame([(k, "Before. " + item) for k in range(6)] + [(9, other)], "doc_id bigint, text string")
    it = spark.createDataFrame([(k, item) for k in range(3)], "item_id bigint, text string")
    aligned, windows, plain = [], [], leaks.map_rows

    def spied(rows, fn, schema):
        out = plain(rows, fn, schema)
        if "_align" in fn.__qualname__:
            aligned.append(rows.count())
        if "_windows" in fn.__qualname__:
            windows.append({r.doc for r in out.collect()})
        return out

    monkeypatch.setattr(leaks, "map_rows", spied)
    found = leaks.leaks(df, it, item_chars=1).collect()
    assert sorted((r.doc, r.item) for r in found) == [(d, i) for d in range(6) for i in range(3)]
    assert aligned == [1] and windows == [set(range(6))]


def test_leak_offsets():
    t = "Ünï—Çøde  ＡＢ İ"
    n = leaks.normal(t)
    assert len(n) == len(leaks.offsets(t)) and n.startswith("uni")


def brute(texts, span):
    ids = [k for k, t in enumerate(texts) if t]
    grams = {k: {texts[k][i : i + span] for i in range(len(texts[k]) - span + 1)} for k in ids}
    return {(a, b) for a in ids for b in ids if a < b and grams[a] & grams[b]}


def test_spans_against_brute_force(spark, words):
    rnd = random.Random(6)
    base = [prose(words, rnd, 120) for _ in range(8)]
    texts = list(base)
    for k, n in enumerate((199, 200, 201, 260, 400)):
        at = rnd.randint(0, 200)
        texts.append(prose(words, rnd, 30) + "#" + base[k][at : at + n] + "#" + prose(words, rnd, 30))
    texts += [base[5], base[5], base[6] + "x", "short", "", None, "ab" * 300, "ab" * 150, "c" * 200, "c" * 199]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, fp int")
    got = {(r.doc_a, r.doc_b) for r in shared_spans.shared_pairs(df).collect()}
    assert got == brute(texts, 200)
    assert {(r.doc_a, r.doc_b) for r in shared_spans.shared_pairs(df, batches=1).collect()} == got
    share = {r.doc: r for r in shared_spans.shared_share(df).collect()}
    assert share[5].share == 1.0 and share[5].n_others == 2 and 200 <= share[9].shared_chars < 230
    assert shared_spans.shared_pairs(df.limit(0)).count() == 0


def test_batches_and_compaction_lose_nothing(spark, words):
    rnd = random.Random(8)
    base = prose(words, rnd, 60)
    texts = [prose(words, rnd, 40) + base[k : k + 220] for k in range(0, 60, 10)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    index = shared_spans.SpanIndex(spark)
    got = set()
    for k in range(len(texts)):
        pairs = index.append(df.where(f"doc_id = {k}"))
        got |= {(r.doc_a, r.doc_b) for r in shared_spans.verified(pairs, df).collect()}
        index.compact()
    assert got == brute(texts, 200) and len(index.store.runs["spans"]) < len(texts)
    index.close(delete=True)


def test_an_index_is_opened_again(spark, words, tmp_path):
    """After each batch the index is left and opened anew; a run that no manifest names, as of a batch that broke off, is not read."""
    rnd = random.Random(18)
    base = prose(words, rnd, 60)
    texts = [prose(words, rnd, 40) + base[k : k + 230] for k in range(0, 60, 10)]
    texts += [texts[1], texts[4], texts[1]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    path, got, members = str(tmp_path / "index"), set(), {}
    for k in range(0, len(texts), 3):
        index, own = shared_spans.SpanIndex(spark, path), df.where(f"doc_id >= {k} and doc_id < {k + 3}")
        same = index.members(own)
        members |= {r.doc: r.rep for r in same.collect()}
        if k == 3:
            index.store.write("spans", shared_spans.fingerprints(own))
        got |= {(r.doc_a, r.doc_b) for r in index.append(own, without=same.select("doc")).collect()}
        index.compact()
        index.close()
    assert members == {6: 1, 7: 4, 8: 1}
    assert got >= {p for p in brute(texts[:6], 200)} and not {x for p in got for x in p} & {6, 7, 8}
    with pytest.raises(ValueError):
        shared_spans.SpanIndex(spark, path, span=300)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidewrack_") and not t.isTemporary]


def test_hot_windows_against_brute_force(spark, words, monkeypatch):
    """A notice of 150 characters on all documents pairs none of them; longer common runs are still found, in one batch and across batches."""
    monkeypatch.setattr(shared_spans, "HOT", 5)
    rnd = random.Random(12)
    notice, long = prose(words, rnd, 40)[:150], prose(words, rnd, 60)[:230]
    texts = [prose(words, rnd, 30) + notice + prose(words, rnd, 30) + (long if k % 9 == 0 else "") for k in range(40)]
    texts[3] = prose(words, rnd, 5) + texts[4][100:310] + prose(words, rnd, 5)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    want = brute(texts, 200)
    assert {(r.doc_a, r.doc_b) for r in shared_spans.shared_pairs(df).collect()} == want
    index = shared_spans.SpanIndex(spark)
    got = {(r.doc_a, r.doc_b) for r in index.append(df.where("doc_id < 20")).collect()}
    second = index.append(df.where("doc_id >= 20"), history=df.where("doc_id < 20"))
    got |= {(r.doc_a, r.doc_b) for r in second.collect()}
    assert {(r.doc_a, r.doc_b) for r in shared_spans.verified(spark.createDataFrame(sorted(got), "doc_a bigint, doc_b bigint"), df).collect()} == want
    assert len(got) < 120


def test_share_of_repeated_and_nested_passages(spark, words):
    """Every place of a shared passage counts on both sides, whichever document has the smaller id."""
    rnd = random.Random(15)
    p, q, long = (prose(words, rnd, 90)[:n] for n in (260, 230, 520))
    once, twice = "1" + p + "2", "3" + p + "4" + prose(words, rnd, 40) + "5" + p + "6"
    whole, pieces = "7" + long + "8", long[:300] + "#" + long[100:420] + "#" + long[250:] + "#" + long[200:450]
    texts = [once, twice, once + "0", q + "9" + q, "a" + q, whole, pieces, "ab" * 150, "z" + "ab" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc: (r.n_others, r.shared_chars) for r in shared_spans.shared_share(df).collect()}
    want = {}
    for i, t in enumerate(texts):
        others = [u for j, u in enumerate(texts) if j != i and any(t[k : k + 200] in u for k in range(len(t) - 199))]
        cover = {c for k in range(len(t) - 199) if any(t[k : k + 200] in u for u in others) for c in range(k, k + 200)}
        want[i] = (len(others), len(cover))
    assert got == want
