"""Problems 4, 5 and 6."""

import random

from tidewrack.llm import line_templates as L
from tidewrack.llm import residue as R
from tidewrack.llm import subjects as B


def test_slots():
    for t in ("in {{city}} today", "${x}", "a %TITLE% b", "<%= y %>", "__LEAD__", "near [[ort]]", "[NAME]", "x [PLACE] y", "<PLACE>", "@@a_b@@", "{1}", "is undefined now"):
        assert R.slots(t), t
    for t in ("[Update] Town", "[อัปเดต] ข่าว", "5 % of 100%", "a < b > c", "#tag", "snake_case", "[UPDATE] all", None or ""):
        assert not R.slots(t), t


def test_residue(spark):
    rows = [
        (1, "A", "{{title}}", "Real news about 5 people who enable JavaScript checks in schools, according to Kovor Lim."),
        (2, "A", "Page not found", "Please enable JavaScript to continue. Your browser settings are blocking this page."),
        (3, "The Post", "undefined | The Post", "PAGE INTROUVABLE"), (4, "A", None, None), (5, "A", "", " "), (6, "A", "Error 417: page unavailable", R.PLACEHOLDER),
        (7, None, "The ministry's portal showed visitors an error 404 page for 43 hours", "Lorem ipsum dolor sit amet consectetur elit"),
        (8, "A", "ไม่พบหน้าเว็บ", "เว็บไซต์ของเทศบาลขึ้นข้อความไม่พบหน้านาน 98 ชั่วโมง ชาวบ้านร้องเรียนแล้ว 5 ราย"), (9, "A", "null", "Figures released by the ${place} office reached 5 per cent."), (2, "A", "Page not found", "x " * 50_000),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "ingest_seq bigint, source string, title string, summary string, field string")
    got = {(r.ingest_seq, r.field): r.kind for r in R.residue(df).collect()}
    assert got == {(1, "title"): "slot", (2, "title"): "residue", (2, "summary"): "residue", (3, "title"): "slot", (3, "summary"): "residue", (6, "title"): "residue", (7, "summary"): "residue", (8, "title"): "residue", (9, "title"): "residue", (9, "summary"): "slot"}
    assert R.residue(df.limit(0)).count() == 0


FIELD_NAMES = ["title", "NAME", "your headline", "place_name", "标题", "ชื่อเรื่อง", "DATUM", "date", "city", "titre"]
MARKS = ["{{{{{}}}}}", "{{{{ {} }}}}", "${{{}}}", "{{% {} %}}", "<%= {} %>", "[[{}]]", "[{}]", "(((({}))))", "(({}))", "<<{}>>", "<?= {} ?>"]


def test_held_out_wordings(spark):
    """Wordings that no exemplar holds, by kind: at least nine tenths are found; see the README for the figures."""
    import pathlib

    rows = [x.split("\t") for x in pathlib.Path(__file__).with_name("residue_heldout.tsv").read_text(encoding="utf-8").splitlines() if not x.startswith("#")]
    rnd = random.Random(11)
    # filler made by rule: the usual vocabulary of generators of such text, and invented words with Latin endings
    usual = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor labore magna aliqua pellentesque morbi tristique senectus fames turpis egestas mauris nibh euismod curabitur posuere donec molestie vivamus justo proin tortor nulla quisque nisi elementum ultricies ligula orci luctus phasellus hendrerit imperdiet interdum sodales varius dapibus rhoncus sagittis vulputate".split()
    stems = ["bor", "cal", "dem", "fal", "gor", "lum", "mar", "nov", "pel", "quor", "rast", "sol", "tem", "vul"]
    invented = [a + b for a in stems for b in ("um", "is", "us", "em", "am", "it", "a", "or")]
    for k in range(120):
        rows.append(["filler", "la", " ".join(rnd.choice(usual if k % 2 else invented) for _ in range(rnd.randint(6, 20))).capitalize() + "."])
    for m in MARKS:
        for f in FIELD_NAMES:
            rows.append(["slot", "-", f"Council meets in {m.format(f)} again on 4 May"])
    exemplar_texts = {R.clean(t) for _, _, t in R.exemplars()}
    assert not any(R.clean(t).rstrip('.') in e for kind, _, t in rows if kind in ("error", "script", "blank") for e in exemplar_texts)
    # news about such matters
    news = [
        "The ministry's portal showed visitors an error 404 page for 43 hours", "Kovor Lim asks schools to enable JavaScript lessons for 5 people", "Court orders the site owner to remove the page about the mayor", "A placeholder goal by Tulri Men wins the cup final",
        "Der Zugriff auf das Archiv bleibt nach dem Urteil gesperrt, sagt Anka Velm", "Le serveur du tribunal est resté indisponible pendant 6 jours, selon Oda Brin", "El ayuntamiento retira la página sobre la sequía tras 14 quejas", "เทศบาลแจ้งว่าเว็บไซต์ขัดข้องนาน 43 ชั่วโมง ชาวบ้านร้องเรียนแล้ว 5 ราย", "市政府网站因故障无法访问四小时，居民投诉三十次", "市役所のサイトは四時間にわたり表示できず、住民が苦情を寄せた", "Cổng thông tin của bộ không truy cập được suốt 43 giờ, người dân phản ánh",
        "Vandals removed a page from the parish register, the archive in Hexby said", "Scripts for the new series were blocked by the censor, writer Dora Kelm says", "[Update] Council reviews budget", "[Exclusive] Mayor resigns", "Shares of 5% to 10% were sold", "He wrote a_b and <b>bold</b> text",
    ]
    articles = spark.read.parquet("/root/testdata/sf0.01/articles.parquet")
    df, n = R.frequencies(articles, ["title", "summary"])
    assert n == articles.where("title <> ''").count() + articles.where("summary <> ''").count()
    for index in (R.ExemplarIndex(df, n), R.ExemplarIndex()):
        assert [t for t in news if index.judge(t)] == []
        for kind in ("error", "script", "blank", "filler", "slot"):
            own = [t for k, _, t in rows if k == kind]
            found = sum(index.judge(t) is not None for t in own)
            assert len(own) >= 100
            if index.df is not None or kind != "filler":
                assert found >= 0.9 * len(own), (kind, found, len(own))


def test_hopeless_fields_are_told_by_their_folded_text():
    """The short way and the full one agree, on residue, news, and texts with entities, zero-width characters, figures and the source's name."""
    index = R.ExemplarIndex()
    texts = [t for _, _, t in R.exemplars()] + ["Page not found", "หน้านี้ถูกลบแล้ว", "404 404 404", "Delta Wire", "Please wait | Delta Wire", "page&nbsp;not&nbsp;found", "pa\u200bge not found", "Divers mend the harbour wall for 1,234 crowns", "ชาวบ้าน 5 คน", "เก", "请稍候", "市议会讨论桥梁", "{{title}}", "x", "12 34"]
    for t in texts:
        for source in (None, "Delta Wire"):
            assert index.is_residue(t, B.fold(t), source) == (index.judge(t, source) == "residue"), t


def test_windows_find_residue_in_a_sentence_of_its_own_or_without_stops():
    index = R.ExemplarIndex()
    assert index.judge("page not found sorry the page you requested does not exist please go back to the home page please enable javascript to view this site") == "residue"
    assert index.judge("Page not found. " + "The harbour council of Porvik meets on Monday about ferry fares and timetables. " * 3) is None


def test_templates():
    assert L.template("Shared 1,484 times!") == L.template("shared  12 TIMES") != L.template("shared times")
    assert L.template("--- ") == "" and L.template("12") == L.template("7")


def test_repeated_lines_against_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(400):
        source = rnd.choice(["A"] * 6 + ["B", "C", "", None])
        lines = [f"body {rnd.random()} of text"] + (["Share this – 15 times"] if rnd.random() < 0.05 else []) + (["rare line"] if rnd.random() < 0.015 else []) + (["***"] if rnd.random() < 0.5 else [])
        rnd.shuffle(lines)
        rows.append((k, source, "\n".join(lines + ([lines[0]] if k % 50 == 0 else []))))
    rows += [(900, "A", None), (901, "A", ""), (902, "B", L.PLACEHOLDER)]
    keys = {}
    for i, s, t in rows:
        for x in set(map(L.template, (t or "").split("\n"))) - {""}:
            if s:
                keys.setdefault((s, x), set()).add(i)
    total = {s: sum(r[1] == s for r in rows) for s in ("A", "B", "C")}
    want = {(i, k) for i, s, t in rows if s for k, x in enumerate((t or "").split("\n")) if len(keys.get((s, L.template(x)), ())) >= max(5, 0.03 * total[s])}
    df = spark.createDataFrame([(*r, 0) for r in rows], "ingest_seq bigint, source string, summary string, line_no int")
    assert {(r.ingest_seq, r.line_no) for r in L.repeated_lines(df).collect()} == want and want
    clean = {r.ingest_seq: r.summary for r in L.strip_lines(df).collect()}
    for i, s, t in rows:
        assert clean[i] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want))
    assert L.repeated_lines(df.limit(0)).count() == 0 and L.strip_lines(df.limit(0)).count() == 0


def test_counts_merge_across_flushes(monkeypatch):
    monkeypatch.setattr(L, "FLUSH_LEAVES", 3)
    batch = L._grow()()
    n = {}
    for part in (batch(["A"] * 4, ["one\ntwo", "one", "three\nfour\none", None]), batch(["A"], ["one"]), batch.close()):
        for k, v in zip(part["leaf"], part["n"]):
            n[k] = n.get(k, 0) + v
    assert n[L._name("one")] == 4


def test_token_tree():
    tree = L.TokenTree()
    for line in ("Reporting by Ana Lim for Delta Wire", "Reporting by Bo Kelm for Delta Wire", "Reporting by Cy Dorn Lee for Delta Wire", "Shared 15 times", "shared 7 TIMES!"):
        tree.add(L.tokens(line))
    got = {L.shown(k): n for k, n in tree.leaves()}
    assert got == {"reporting by <*> <*> for delta wire": 2, "reporting by cy dorn lee for delta wire": 1, "shared <#> times": 2}


def test_bylines_with_changing_names_are_one_template(spark, monkeypatch):
    """In several tasks, with early flushes, some of which saw one name only; brute force counts the rows."""
    names = [f"{a} {b}" for a in ("Ana", "Bo", "Cy", "Dee", "Eli") for b in ("Lim", "Kelm", "Dorn", "Brask")]
    rnd = random.Random(3)
    rows = []
    for k in range(600):
        s = rnd.choice(["A"] * 4 + ["B", "", None])
        lines = [f"body {' '.join(rnd.choice('abcdefghijklmnop') * 3 for _ in range(rnd.randint(4, 9)))} {rnd.random()}"] + ([f"Reporting by {rnd.choice(names)} for Delta Wire"] if rnd.random() < 0.3 else []) + (["Share this 5 times"] if rnd.random() < 0.2 else [])
        if k % 40 == 0:
            lines += [f"Reporting by {n} for Delta Wire" for n in names[:2]]
        rows.append((k, s, "\n".join(lines) if k % 97 else None))
    df = spark.createDataFrame([(*r, "x") for r in rows], "ingest_seq bigint, source string, summary string, n string").repartition(7)
    want = {}
    for s in ("A", "B"):
        texts = [t or "" for _, x, t in rows if x == s]
        for start, name in (("Reporting by", "reporting by <*> <*> for delta wire"), ("Share this", "share this <#> times")):
            want[s, name] = sum(any(x.startswith(start) for x in t.split("\n")) for t in texts)
    for group in (512, 2):
        monkeypatch.setattr(L, "FLUSH_GROUP", group)
        got = {(r.source, r.template): r.n for r in L.learned_templates(df, min_share=0.1).collect()}
        assert {k: n for k, n in got.items() if not k[1].startswith("body")} == want
    assert L.learned_templates(df.limit(0)).count() == 0


def test_repeated_lines_are_fillings_of_merged_templates(spark, monkeypatch):
    """Slots are learned and merged across tasks, but only fillings that many rows hold are cases, in any spacing, whether the trees are handed out or joined."""
    rows = [(k, "A", f"Reporting by {'Ana Lim' if k % 4 else f'N{chr(97 + k % 23)} Kelm'} for Delta Wire\nbody {chr(97 + k % 26) * 3} {chr(97 + k % 19) * 4} {k}") for k in range(40)]
    rows += [(50 + k, "A", "reporting  by ana lim forDelta Wire") for k in range(2)]
    df = spark.createDataFrame(rows, "ingest_seq bigint, source string, summary string").repartition(5)
    want = {(k, 0) for k in range(40) if k % 4} | {(50, 0), (51, 0)}
    kept = L.repeated_fillings(df).collect()
    assert {L.shown(r["key"]) for r in kept} == {"reporting by <*> <*> for delta wire", "reporting by ana lim fordelta wire"} and {bytes(r["leaf"]) for r in kept} == {L._name(L.template("Reporting by Ana Lim for Delta Wire"))}
    for few in (True, False):
        monkeypatch.setattr(L, "bounded", lambda df, few=few: few)
        assert {(r.ingest_seq, r.line_no) for r in L.repeated_lines(df).collect()} == want


def test_subjects(spark):
    rnd = random.Random(2)
    topics = {"sports": ["head coach", "relay team", "boxing bout", "league table", "penalty kick", "city marathon"], "health": ["flu season", "hospital beds", "vaccine drive", "nursing rota", "dengue cases", "outpatient clinic"]}
    known = {k: v[:4] for k, v in topics.items()}
    frames = ["Residents counted 5 complaints about the {} since May.", "Work on the {} near Porvik stopped for 7 hours.", "Critics ignored 4 warnings about the {} again.", "Preparations for the {} in Hexby began late."]
    rows, want = [], {}
    for k in range(400):
        s = rnd.choice(list(topics))
        rows.append((k, "A", f"Council defends {rnd.choice(topics[s])} plan worth 5 crowns", " ".join(rnd.choice(frames).format(rnd.choice(topics[s])) for _ in range(4))))
        want[k] = {s}
    rows += [(900, "A", None, None), (901, "A", "", " "), (902, "A", "{{title}}", "Page not found"), (903, "A", "Council links head coach and flu season", ""), (903, "A", "Council links head coach and flu season", "")]
    want[903] = {"sports", "health"}
    df = spark.createDataFrame([(*r, "x") for r in rows], "ingest_seq bigint, source string, title string, summary string, subject string")
    lexicon = spark.createDataFrame([(s, p) for s, ps in known.items() for p in ps], "category string, keyword string")
    hand = spark.createDataFrame([(0, "world"), (1, "nonsense"), (903, "sports")], "ingest_seq bigint, subject string")
    got = {}
    for r in B.subjects(df, lexicon, hand).collect():
        got.setdefault(r.ingest_seq, set()).add(r.subject)
    assert sum(got.get(k) == v for k, v in want.items()) / len(want) > 0.95 and not {900, 901, 902} & set(got)
    assert B.subjects(df.limit(0), lexicon, hand).count() == 0
    assert B.subjects(df, lexicon.limit(0), hand.limit(0)).count() == 0


def rare_phrases(spark, n):
    """A table of ``n`` rows, the phrases of few of which are in no lexicon."""
    frames = ["Residents counted 5 complaints about the {} since May.", "Work on the {} near Porvik stopped for 7 hours.", "Critics ignored 4 warnings about the {} again."]
    known = ["head coach", "relay team", "boxing bout", "league table"]
    rows = [(k, "A", f"Plan for the {known[k % 4]}", frames[k % 3].format(known[k // 3 % 4])) for k in range(48)]
    rows += [(100 + k, "A", None, frames[k % 3].format("table tennis hall") + " " + frames[(k + 1) % 3].format(known[k % 4])) for k in range(3)]
    rows += [(200 + k, "A", None, frames[k % 3].format("table tennis hall")) for k in range(3)]
    df = spark.createDataFrame(rows, "ingest_seq bigint, source string, title string, summary string")
    empty = spark.range(1_000, 1_000 + n).selectExpr("id AS ingest_seq", "'A' AS source", "'Nothing' AS title", "'' AS summary")
    lexicon = spark.createDataFrame([("sports", p) for p in known], "category string, keyword string")
    return df.unionByName(empty), lexicon, spark.createDataFrame([], "ingest_seq bigint, subject string")


def test_rare_phrases_of_a_large_table(spark):
    got = {(r.ingest_seq, r.subject) for r in B.subjects(*rare_phrases(spark, 60_000)).collect()}
    assert got == {(k, "sports") for k in (*range(48), 100, 101, 102, 200, 201, 202)}


def test_blocks_of_phrases_equal_one(spark, monkeypatch):
    df, lexicon, hand = rare_phrases(spark, 5)
    lexicon = lexicon.unionByName(spark.createDataFrame([("health", "table")], "category string, keyword string"))
    df = df.unionByName(df.where("ingest_seq < 3"))
    want = {(r.ingest_seq, r.subject): round(r.share, 9) for r in B.subjects(df, lexicon, hand).collect()}
    phrases = [{"table": 0, "head coach": 1}, {"table tennis hall": 2, "league table": 3}]
    whole, split = ([spark.sparkContext.broadcast(b) for b in x] for x in ([phrases[0] | phrases[1]], phrases))
    edges = [B.document_phrases(df, b, "ingest_seq", "title", "summary", "source").groupBy("doc", "phrase").agg({"title": "sum", "n": "sum"}).collect() for b in (whole, split)]
    assert edges[0] and sorted(edges[0]) == sorted(edges[1])
    monkeypatch.setattr(B, "BLOCK", 1)
    assert {(r.ingest_seq, r.subject): round(r.share, 9) for r in B.subjects(df, lexicon, hand).collect()} == want


def test_texts_are_folded_once_for_all_scans(spark):
    df = spark.createDataFrame([(1, "A", "ＰＬＡＮ for 1,234 Miles", None), (2, None, None, "Straße 5\nงานน้ำ")], "ingest_seq bigint, source string, title string, summary string")
    docs = B.folded(df, "ingest_seq", "title", "summary", "source")
    got = {r.doc: (r.ft, r.fs, r.title, r.summary, r.source) for r in docs.collect()}
    assert got[1] == ("plan for 0 miles", "", "ＰＬＡＮ for 1,234 Miles", None, "A") and got[2] == ("", B.fold("Straße 5\nงานน้ำ"), None, "Straße 5\nงานน้ำ", None)
    assert list(B._joint(["plan", ""], ["", "b"])) == ["plan\n", "\nb"]


def test_trusted_hand_labels_stand_in_the_result(spark):
    df, lexicon, _ = rare_phrases(spark, 3)
    more = [(300, "A", "An evening with the archive", "Nothing known here."), (301, "A", "{{title}}", "Page not found"), (302, "A", None, " "), (303, "A", "No label either", "")]
    df = df.unionByName(spark.createDataFrame(more, df.schema))
    hand = spark.createDataFrame([(300, "world"), (300, "society"), (301, "world"), (302, "world"), (0, "health"), (999_999, "world")], "ingest_seq bigint, subject string")
    got = {(r.ingest_seq, r.subject): r.share for r in B.subjects(df, lexicon, hand).collect()}
    assert {k: v for k, v in got.items() if k[0] >= 300} == {(300, "world"): 0.5, (300, "society"): 0.5}
    assert (0, "sports") in got and (0, "health") not in got
