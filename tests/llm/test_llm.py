"""Text-corpus operators: hand-made cases, brute force, round trips, held-out accuracy, and the awkward inputs."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import connect, same  # noqa: E402

from strataquill.llm import arrays, leakage, mixing, neardup, queries, residue, sentences, spans, splitting, textform  # noqa: E402

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def frame(spark, texts, extra="clash"):
    """id, text and a column whose name clashes with what operators use inside."""
    return spark.createDataFrame([(str(i), t, extra) for i, t in enumerate(texts)], "id string, text string, end_pos string")


# Splitting ----------------------------------------------------------------------------------------------------------


def test_pieces_round_trip(spark):
    rng = random.Random(1)
    words = ["收入增长。", "，", "net profit ", "\n\n", "123.45 ", "“引用。”", "é", "!"]
    texts = ["".join(rng.choice(words) for _ in range(n)) for n in (10, 300, 900, 4000)] + ["x" * 5000, "", None, "a" * 1200, "b" * 1201, " " * 3000, "e" + "́" * 2500]
    pieces = splitting.split_oversized(frame(spark, texts), ["id"], "text").collect()
    by = {}
    for r in sorted(pieces, key=lambda r: (int(r.id), r.piece_index)):
        by.setdefault(int(r.id), []).append(r)
    assert set(by) == {i for i, t in enumerate(texts) if t and len(t) > 1200}
    for i, rows in by.items():
        assert [r.piece_index for r in rows] == list(range(len(rows)))
        assert all(0 < len(r.piece_text) <= 1200 and r.piece_text == texts[i][r.start_pos : r.end_pos] for r in rows)
        assert all(b.start_pos == a.end_pos - 100 for a, b in zip(rows, rows[1:], strict=False))
        assert rows[0].piece_text + "".join(r.piece_text[100:] for r in rows[1:]) == texts[i]


def test_pieces_end_at_sentences():
    text = "".join(f"第{i}句话在这里结束了。" for i in range(300))
    assert all(text[e - 1] == "。" for e in splitting.cut_positions(text, 1200, 100))


def test_cuts_are_optimal():
    """Against all choices of cuts on a short text."""
    text, limit, overlap = "aa bb. cc dd, ee.", 8, 2

    positions, penalty = splitting.boundary_positions(text, limit - overlap)
    cost_of = dict(zip(positions.tolist(), penalty.tolist(), strict=True))
    target = (len(text) - overlap) / -(-(len(text) - overlap) // (limit - overlap))

    def cost(ends):
        total, last = 0.0, None
        for e in ends:
            step = e - overlap if last is None else e - last
            total += cost_of[e] + splitting.BALANCE * ((step - target) / target) ** 2
            last = e
        return total

    def every(last):
        if last == len(text):
            yield ()
        for e in positions.tolist():
            if e > last and (e - last <= limit - overlap if last else e <= limit) and (last == 0 or last >= overlap):
                for rest in every(e):
                    yield (e, *rest)

    assert cost(splitting.cut_positions(text, limit, overlap)) == pytest.approx(min(cost(c) for c in every(0)))


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        splitting.split_oversized(frame(spark, ["a"]), ["end_pos"], "text")
    with pytest.raises(ValueError):
        sentences.split_sentences(frame(spark, ["a"]), ["end_pos"], "text")


# Sentences ----------------------------------------------------------------------------------------------------------

CASES = [
    ["收入3.5亿元。", "利润呢？", "很好！", "未完……", "完"],
    ["管理层称“增长。还会更好。”并将目标定为3亿元。", "公告写明：“将支付5元。”", "其他（见附注。）不变；再看。"],
    ["Approx. RMB 3.5 bn vs. 4.1 bn was paid by Co., Ltd. on 3 Aug. 2020.", "105. As of today, it holds.", 'He said "no. Never." before it fell.', 'It reads: "Paid by May."', "See www.a-b.com/x?y=1 now!"],
    ["Laut Vertrag Nr. 5 wurden z. B. 8.157,45 EUR, d. h. ca. 3 Mio. EUR, gezahlt.", "Er sagte: „Gut. Sehr gut.“", "Ende?"],
    ["Réf. 12 : la société S.A. a progressé de 5,2 M€.", "Elle a dit : « Oui. Non. »", "Vraiment ?"],
    ["経営陣は「安定している。改善する。」と述べた。", "返済できるのか？"],
    ["डॉ. समिति ने 36,904.52 रुपये तय की।", "क्या मिलेगा?"],
    ["บริษัทมีรายได้ 5.2 ล้านบาท", "หนี้สินของ Abc Capital เพิ่มขึ้น"],
    ["第一段没有句号", "第二段。", "单\n行不断。"],
    ["a b c"],
]
JOINS = ["", "", " ", " ", " ", "", " ", " ", None, ""]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_sentences(spark, case):
    parts = CASES[case]
    text = "第一段没有句号\n\n第二段。单\n行不断。" if JOINS[case] is None else JOINS[case].join(parts)
    got = [r.sentence for r in sentences.split_sentences(frame(spark, [text]), ["id"], "text").orderBy("sentence_index").collect()]
    assert got == parts


def test_sentences_odd_input(spark):
    texts = [None, "", " \n ", "。", "  a. ", "“没有结尾。下一句。", "很长" * 60000 + "。", "一句。" * 20000, "é. B。"]
    rows = sentences.split_sentences(frame(spark, texts), ["id"], "text").collect()
    count = {i: sum(r.id == str(i) for r in rows) for i in range(len(texts))}
    assert count[0] == count[1] == count[2] == 0 and count[3] == count[4] == 1 and count[6] == 1 and count[7] == 20000
    assert all(texts[int(r.id)][r.start_pos : r.end_pos] == r.sentence and r.sentence.strip() == r.sentence for r in rows)
    assert [r.end_pos for r in rows if r.id == "4"] == [4]


def test_sentences_of_long_quotations(spark):
    """Enclosed stretches of any length and nesting take no stack; positions hold in texts of very many sentences."""
    quoted = "“" + "引文一句。\n" * 17000 + "”他说。"
    straight = '"' + "one line.\n" * 10000 + '" he said. Then it ended.'
    nested = "(" + "(a)" * 50000 + ") done. Next."
    opened = "(" * 50000 + "It ends. But not here."
    many = "Short one. " * 60000
    texts = [quoted, straight, nested, opened, many]
    rows = sentences.split_sentences(frame(spark, texts), ["id"], "text").collect()
    ends = {i: sorted(r.end_pos for r in rows if r.id == str(i)) for i in range(len(texts))}
    assert ends[0] == [len(quoted)] and ends[2] == [len(nested) - 6, len(nested)] and ends[3] == [50008, len(opened)]
    assert ends[1] == [straight.index(" Then"), len(straight)]
    assert ends[4] == [10 + 11 * i for i in range(60000)] and all(r.sentence == texts[int(r.id)][r.start_pos : r.end_pos] for r in rows)


# One form -----------------------------------------------------------------------------------------------------------


def test_one_form():
    same_look = ["Résumé ABC 12 利金", "Résumé ＡВС　１２ 利⾦", "Ré​su­mé ΑBC 1⁠2 利金"]
    assert len({textform.one_form(t, False) for t in same_look}) == 1
    for a, b in (("A", "a"), ("，", ","), ("a\nb", "a b"), ("x²", "x2"), ("（", "("), ("㎡", "m2")):
        assert textform.one_form(a, False) != textform.one_form(b, False)
    assert textform.one_form("Straße", True) == textform.one_form("STRASSE", True)
    assert textform.one_form("", True) == "" and textform.one_form("𝐀b", False) == "Ab"


def test_twins(spark):
    df = frame(spark, ["abc １", "abc 1", "abc 1", "Abc 1", None, "", "", "x", "x​"])
    assert {r.id for r in textform.differing_twins(df, "id", "text").collect()} == {"0", "1", "2", "7", "8"}
    assert textform.differing_twins(df.limit(0), "id", "text").count() == 0
    paths = spark.createDataFrame([("a", ["Ｒ&D"]), ("b", ["R&D"]), ("c", None), ("d", []), ("e", [None, "r&d"])], "id string, p array<string>")
    titles = spark.createDataFrame([("R&D",), (None,)], "t string")
    assert [r.id for r in textform.differing_titles(paths, "id", "p", titles, "t").collect()] == ["a"]


# Near-duplicates ----------------------------------------------------------------------------------------------------


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        t[rng.randrange(len(t))] = rng.choice("甲乙丙丁戊己")
    return "".join(t)


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(200)) for _ in range(40)]
    texts = base + [edited(rng, rng.choice(base), rng.choice([1, 3, 6])) for _ in range(120)] + [base[0], " ".join(base[0]), base[1][:4], None, ""]
    shingle = lambda t: {"".join(t.split())[i : i + 5] for i in range(len("".join(t.split())) - 4)}
    sets = [shingle(t) if t else set() for t in texts]
    want = {tuple(sorted((str(i), str(j)))) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    df = frame(spark, texts).unionByName(frame(spark, texts).limit(5))
    got = {(r.id_a, r.id_b) for r in neardup.similar_pairs(df, "id", "text").collect()}
    assert not got - want and len(want - got) <= 0.01 * len(want)
    assert neardup.similar_pairs(df.limit(0), "id", "text").count() == 0


def test_groups(spark):
    members = spark.createDataFrame([(f"k{i}", i) for i in range(9)], "id string, class_id long")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 5), (3, 4), (6, 7)], "class_a long, class_b long")
    got = {r.id: (r.group_id, r.links) for r in neardup.groups(members, links, "id").collect()}
    assert got == {"k0": (0, 1), "k1": (0, 2), "k2": (0, 2), "k5": (0, 1), "k3": (3, 1), "k4": (3, 1), "k6": (6, 1), "k7": (6, 1), "k8": (8, 0)}


def test_long_chain_of_links(spark):
    n = 200
    members = spark.createDataFrame([(str(i), i) for i in range(n)], "id string, class_id long")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "class_a long, class_b long")
    assert {r.group_id for r in neardup.groups(members, links, "id").collect()} == {0}


# Shared spans -------------------------------------------------------------------------------------------------------


def test_shared_runs_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    rows = []
    for i in range(150):
        whole = text(300)
        cut = rng.randrange(0, 170)
        rows.append((f"a{i}", f"d{i % 40}", whole))
        rows.append((f"b{i}", f"d{i % 37}", text(50) + whole[cut : cut + rng.choice([119, 120, 130])] + text(60)))
    rows += [("p", "x", "ab" * 200), ("q", "y", "z" + "ab" * 90), ("r", "x", "c" * 500), ("s", "y", "c" * 130), ("t", "y", None), (None, "y", "c" * 200), ("u", None, "c" * 200), ("v", "y", ""), ("w", "z", rows[0][2])]
    df = spark.createDataFrame(rows, "id string, doc string, text string")
    windows = [(i, d, {t[j : j + 120] for j in range(len(t) - 119)}) for i, d, t in rows if i and d and t]
    want = {(i, e) for i, d, x in windows for _, e, y in windows if d != e and x & y}
    got = {(r.id, r.other_doc) for r in spans.shared_with(df.unionByName(df.limit(3)), "id", "doc", "text").collect()}
    assert got == want
    assert spans.shared_with(df.limit(0), "id", "doc", "text").count() == 0 and spans.shared_shares(df.limit(0), "id", "doc", "text").count() == 0

    def part(d, t):
        on = set()
        for j in range(len(t) - 119):
            if any(e != d and t[j : j + 120] in y for _, e, y in windows):
                on |= set(range(j, j + 120))
        return len(on)

    shares = {r.id: (r.chars, r.shared_chars) for r in spans.shared_shares(df, "id", "doc", "text").collect()}
    assert shares == {i: (len(t), part(d, t)) for i, d, t in rows if i and d and t is not None}


def keyed(texts, run=120):
    """For each text, the keys under which each of its windows lies."""
    which, keys, first, last = spans.keyed_windows(texts, run, 64, 6, 12)
    out = [{} for _ in texts]
    for w, k, a, b in zip(which.tolist(), keys.tolist(), first.tolist(), last.tolist(), strict=True):
        for p in range(a, b + 1):
            out[w].setdefault(texts[w][p : p + run], set()).add(k)
    return out


@pytest.mark.parametrize("letters", ["abcdefgh ", "ab", "a", "甲乙丙丁戊己庚辛壬癸，。", "x\U0001f600"])
def test_every_shared_window_shares_a_key(letters):
    """The guarantee, with periodic texts and long runs of one character among them."""
    rng = random.Random(6)

    def text(n):
        out = ""
        while len(out) < n:
            out += rng.choice(letters) * rng.choice([1, 1, 1, 1, 2, 70]) if rng.random() < 0.9 else rng.choice(["ab" * 40, "-" * 130, "abc" * 50])
        return out[:n]

    for _ in range(60):
        core = text(rng.choice([120, 121, 150, 300]))
        texts = [text(rng.randrange(0, 90)) + core + text(rng.randrange(0, 90)) for _ in range(2)] + ["", core[:119], core]
        held = keyed(texts)
        for t, windows in zip(texts, held, strict=True):
            assert set(windows) == {t[i : i + 120] for i in range(len(t) - 119)}
        for a in held:
            for b in held:
                assert all(a[w] & b[w] for w in set(a) & set(b))


# Leakage ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [10**6, 0])
def test_leaks_against_brute_force(spark, limit):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop,") for _ in range(n))
    items = [text(200) for _ in range(8)] + ["short", "", None]
    docs = [text(100) + items[rng.randrange(8)][a : a + rng.choice([30, 60, 120, 200])].upper() + text(100) for a in (0, 20, 50) for _ in range(15)] + [None, "", "Ａ" * 50, "é" * 60]
    reduce = leakage.reduce_text

    def share(p, t):
        p, t = reduce(p or ""), reduce(t or "")
        on = set()
        for i in range(len(p) - 39):
            if p[i : i + 40] in t:
                on |= set(range(i, i + 40))
        return len(on) / len(p) if p else 0

    want = {(str(i), str(j)): share(p, t) for i, t in enumerate(docs) for j, p in enumerate(items) if share(p, t)}
    got = leakage.leaked(frame(spark, docs), "id", "text", frame(spark, items).withColumnRenamed("id", "case"), "case", "text", broadcast_chars=limit).collect()
    assert {(r.id, r.case): pytest.approx(r.share) for r in got} == want


def test_reduction_is_that_of_single_texts():
    texts = ["ＡＢＣ é é ½ ㎡", "", "ｶﾞ かﾞ", "Σς", "𝐀 x", "ไทย ำ", "डॉ.", "힣한"]
    codes, starts = leakage.reduced(texts)
    assert ["".join(map(chr, codes[a:b])) for a, b in zip(starts, starts[1:], strict=False)] == [leakage.reduce_text(t) for t in texts]


# Mixing -------------------------------------------------------------------------------------------------------------

BPE = "/opt/tokenizers/piece_bpe_32k.model"
tokenizers_here = pytest.mark.skipif(not os.path.exists(BPE), reason="tokenizer files are not here")


@tokenizers_here
def test_mixture_reaches_targets(spark):
    rows = [(i, ("alpha beta gamma " if s == "x" else "盈利增长 ") * 20, s) for i, s in enumerate(["x"] * 400 + ["y"] * 150 + ["z"] * 5)] + [(900, None, "x"), (901, "", "y")]
    docs = spark.createDataFrame(rows, "doc long, text string, source string")
    plan = spark.createDataFrame([("x", 0.5, 2), ("y", 0.3, 3), ("z", 0.2, 2)], "source string, target_share double, max_repeats int")
    used, report = mixing.mixture(docs, "doc", "text", "source", plan, BPE)
    told = {r.source: r for r in report.collect()}
    assert told["x"].reachable and told["y"].reachable and not told["z"].reachable
    assert told["x"].reached_tokens == pytest.approx(told["x"].target_tokens, rel=1e-3) and told["z"].reached_tokens < 0.5 * told["z"].target_tokens
    got = {r.source: r for r in used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t"), F.max("repeats").alias("m"), F.max("rate").alias("r")).collect()}
    assert all(r.m <= cap and r.r <= cap for r, cap in ((got["x"], 2), (got["y"], 3), (got["z"], 2)))
    assert all(got[s].t == pytest.approx(told[s].target_tokens, rel=0.2) for s in "xy")
    assert used.count() == len(rows)


@tokenizers_here
def test_unlabelled_documents_get_posteriors(spark):
    rows = [(i, ("alpha beta gamma %d " % i if i % 2 else "盈利增长%d，" % i) * 5, None if i % 10 < 2 else ("x" if i % 2 else "y")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc long, text string, source string")
    sized = mixing.measured(docs, "doc", "text", "source", ["x", "y"], BPE).collect()
    assert all(sum(r.member) == pytest.approx(1) for r in sized)
    assert sum(r.member[0 if r.doc % 2 else 1] for r in sized) > 0.95 * len(sized)
    quality = {r.source: r for r in mixing.domain_quality(docs, "doc", "text", "source", ["x", "y"], pool=150).collect()}
    assert all(r.accuracy > 0.95 and r.log_loss < r.prior_log_loss for r in quality.values())


def test_posteriors_are_tempered_where_texts_tell_nothing():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(100)) for _ in range(600)]
    labels = [rng.choice("xxxy") for _ in texts]
    model = mixing.Domains.fit(texts, labels, ["x", "y"])
    alone, told = model.posterior(texts), model.posterior(texts, labels)
    assert np.abs(alone[:, 0] - 0.75).max() < 0.25
    assert all(p["xy".index(x)] > 0.9 for p, x in zip(told, labels, strict=True))


@tokenizers_here
def test_rates_match_the_least_squares_solution(spark):
    """Overlapping domains against plain projected gradient steps on the rates themselves."""
    rng = np.random.default_rng(9)
    member = rng.multinomial(20, [0.5, 0.3, 0.2], 300) / 20
    tokens = rng.integers(1, 50, 300)
    sized = spark.createDataFrame([(i, "abc"[i % 3], int(t), m.tolist()) for i, (t, m) in enumerate(zip(tokens, member, strict=True))], "doc long, source string, tokens long, member array<double>")
    target, caps = np.array([0.2, 0.3, 0.5]), np.array([2.0, 1.0, 3.0])
    rate, report = mixing.fit_rates(sized, list("abc"), target.tolist(), caps.tolist())
    got = np.array([r.r for r in sized.select("doc", rate.alias("r")).orderBy("doc").collect()])
    cap, own = caps[np.arange(300) % 3], member.T @ tokens
    r = np.ones(300)
    for _ in range(5000):
        r = np.clip(r + member @ ((target * own.sum() - member.T @ (tokens * r)) / own), 0, cap)
    loss = lambda x: (((target * own.sum() - member.T @ (tokens * x)) ** 2) / own).sum()
    assert loss(got) <= loss(r) + 1e-3 * loss(np.ones(300)) and (got <= cap).all() and (got >= 0).all()


# Residue ------------------------------------------------------------------------------------------------------------


def test_placeholders():
    bad = ["金额{{amount}}元", "由${name}承建", "截至____，", "占【】", "为【待补充】", "<%= x %>", "占XXXX", "#REF!", "%(amt)s", "[TBD]", "某某某", "于yyyy-mm-dd", "向{0}采购"]
    good = ["字段“{{amount}}”由系统填充", '"{{period}}"', "规模为【12,345.00】万元", "[3] see", "{a}", "x_y", "第（3）条", "C# 语言", "待检设备"]
    assert all(map(residue.holds_placeholder, bad)) and not any(map(residue.holds_placeholder, good))


@here
def test_residue_on_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = residue.fit(residue.training_texts(docs, "doc_id", "text", 20000, "doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1 and text is not null").select("doc_id", "text").collect()
    verdict = model.judge([r.text for r in rows])
    truth = []
    for r in rows:
        labels = [x for _, x in residue.labelled([r.text])]
        truth.append(residue.holds_placeholder(r.text) or any(x[1] for x in labels) and all(x[1] or x[2] for x in labels))
    truth, told = np.array(truth), verdict > 0
    assert (told & ~truth).sum() <= 1 and (told & truth).sum() >= 0.9 * truth.sum()


@here
def test_short_sentences_and_unseen_wordings(spark):
    """Ordinary one-line disclosures of words the fit has not seen are kept; most unseen wordings of residue are found."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = residue.training_texts(docs, "doc_id", "text", 20000)
    plain = ["公司不存在重大诉讼。", "本期债券不设担保。", "The bonds are unsecured.", "公司无对外担保。", "审计意见为标准无保留意见。", "不适用", "报告期内无重大变化。", "No dividends were paid.", "Die Anleihe ist unbesichert.", "L'émetteur n'a pas de litige.", "当社に重要な訴訟はない。", "公司住所未发生变更。", "募集资金已全部使用完毕。", "Interest is paid annually."]
    model = residue.fit(texts)
    assert not model.judge(plain).any()
    assert (model.judge(["系统维护中，请稍后访问本页面。", "HTTP Error 502: the server could not complete your request.", "Please log in to view this page."]) == 2).all()
    folds = residue.held_out_families(texts, 3)
    assert sum(f[3] for f in folds) >= 0.6 * sum(f[2] for f in folds) and sum(f[4] for f in folds) <= 3


def test_residue_odd_input(spark):
    texts = ["系统繁忙，请稍后再试。", "净利润增长了百分之五，公司经营稳定。", None, "", "\n", "金额为____元。"] * 20
    got = {(int(r.id) % 6, r.kind) for r in residue.find_residue(frame(spark, texts), "id", "text").collect()}
    assert got == {(0, "filler"), (5, "placeholder")}
    assert residue.find_residue(frame(spark, []), "id", "text").count() == 0


def test_validation_scores_every_held_out_text(spark):
    docs = spark.range(2300).select("id", F.lit("公司公告\n本期净利润增长了百分之五，公司经营稳定。").alias("text"), F.lit("C1").alias("host"))
    got = {r.label: (r.segments, r.precision, r.recall) for r in residue.validate(docs, "id", "text", "host", held_out=1).collect()}
    # All hosts are held out, so the model is blank: every segment scores 0, above the lenient threshold and not beyond doubt.
    assert got["furniture"] == (2300, 0.5, 1.0) and got["placeholder"] == (0, 0.0, 0.0) and got["text"] == (0, 0.0, 0.0)
    late = residue.labelled(["公司经营稳定。" * 80 + "\nLorem ipsum dolor sit amet."])
    assert all(labels[1] for _, labels in late)


def test_families_are_counted_over_all_texts(spark):
    """Long texts and ordinary ones beyond the first thousands are part of the fit and of the counts."""
    texts = ["系统繁忙。\n" * 4000] * 2 + ["Access denied."] * 3 + ["公司经营稳定，净利润增长了百分之五。"] * 2500 + [None, ""]
    got = residue.validate_families(frame(spark, texts), "id", "text").collect()
    assert sum(r.texts for r in got) == 5 and [r.families for r in got] == [15, 15, 14, 14, 14] and sum(r.false_alarms for r in got) == 0


def test_fit_where_the_data_are_is_the_fit_in_memory(spark, monkeypatch):
    texts = ["系统繁忙，请稍后再试。", "净利润增长了百分之五，公司经营稳定。", "金额为____元。", "公告标题", "The bonds are unsecured. Interest is paid annually."] * 40
    docs, folds = frame(spark, [f"{t}\n第{i}号公告已经披露。" if i % 3 else t for i, t in enumerate(texts)]), residue._folds(2)
    size, without = sum(len(r.text) for r in docs.collect()), [inside for inside, _ in folds]
    near = residue.fit_all(docs, "id", "text", without=without)
    monkeypatch.setattr(residue, "SLICE", size - 1)
    far = residue.fit_all(docs, "id", "text", without=without)
    assert near.grams.any() and near.grams.shape == (residue.BUCKETS, 6) and np.allclose(near.grams, far.grams, atol=0.05) and np.allclose(near.dense, far.dense, atol=0.05)
    assert residue.slices(size * 7) == 6 and residue.slices(size * 1000) == 60 and residue.slices(0) == 1


def test_labels_are_those_of_the_patterns():
    texts = ["İ系统繁忙。TBD.", "错误 ４０４：\n\n【 】x。[INSERT NAME] {1} 𝟎", "错误 𝟒𝟎𝟒：页面", "", " \n", "a.", "[ ]", "　\n12 May 2020\n", "x\r\ny 2020年1月1日\r\n", "公司经营稳定。Lorem ipsum dolor.", "${name}与（待补充）。真实文字在这里。"]
    for text in texts:
        got, at = residue.labelled([text]), 0
        for segment, labels in got:
            at = text.index(segment, at)
            first = at + len(segment) - len(segment.lstrip())
            line = text[text.rfind("\n", 0, first) + 1 :].split("\n", 1)[0]
            assert labels == tuple(map(bool, residue.weak_labels(segment, line, "lorem ipsum" in text.lower())))
            at += len(segment)


def test_ordinary_texts_are_judged_by_one_sentence(monkeypatch):
    """Verdicts are those of all segments, but a text with a sentence of content is not scored any further."""
    plain = "".join(f"公司第{i}项业务经营稳定，净利润增长了百分之五。\n" for i in range(40))
    bad = ["金额{{amount}}元", "由${name}承建", "截至____，", "占【】", "为【待补充】", "<%= x %>", "占XXXX", "#REF!", "%(amt)s", "[TBD]", "某某某", "于yyyy-mm-dd", "向{0}采购", "向{𝟎}采购", "（公司全称）", "[\n]", "<<名称>>", "ｘｘｘ", "@@id@@", "[INSERT NAME]"]
    odd = ["", " \n", "系统繁忙，请稍后再试。", "系统繁忙，请稍后再试。\n刷新", "公告标题\n错误 404：页面不存在。\n" + plain, "Access denied.", "不适用", "“{{amount}}”由系统填充。"]
    texts = [plain + b + "。\n" + plain for b in bad] + bad + odd + [plain] * 20
    model = residue.fit(texts)
    seg, told = model.decide(texts)
    assert model.judge(texts).tolist() == residue.verdicts(seg, told, len(texts)).tolist()
    assert model.judge(texts)[: len(bad)].all() and (model.judge(odd)[2:4] == 2).all() and not model.judge([]).any()
    assert all(len(residue.places(residue.Segments.of([b]).codes)) for b in bad)
    scored, scores = [], residue.Model.scores
    monkeypatch.setattr(residue.Model, "scores", lambda self, some: scored.append(len(some.bounds)) or scores(self, some))
    assert not model.judge([plain] * 50).any() and sum(scored) <= 100 < len(residue.Segments.of([plain] * 50).bounds)


def test_a_text_is_judged_without_its_neighbours():
    blank = residue.Model(np.zeros((residue.BUCKETS, 3), np.float32), np.zeros((residue.WIDTH, 3), np.float32))
    assert blank.judge(["见附注[ ", "]所示"]).tolist() == [0, 0] and blank.judge(["见附注[ ]所示"]).tolist() == [1]
    assert not blank.decide(["见附注[ ", "]所示"])[1][:, 0].any()


def test_grams_stay_in_their_segments():
    seg = residue.Segments.of(["a. b", "x", "公司经营稳定。净利润 100 万元！\n\n \n好", "", "ab。"])
    for some in (seg, seg.take(np.arange(len(seg.text))[::-2])):
        for n, (number, bucket) in zip(residue.GRAMS, some.grams(), strict=True):
            direct = [arrays.kgrams(arrays.mix(seg.codes[lo:hi]), n) >> np.uint64(46) for lo, hi in some.bounds]
            assert number.tolist() == [len(x) for x in direct] and bucket.tolist() == np.concatenate(direct).tolist()


def test_search_scores_miss_and_find_gold(spark, tmp_path):
    passage, other = ("".join(chr(0x4E00 + 97 * i % 5000 + at) for i in range(60)) for at in (0, 7000))
    docs = [(1, "盈利情况如何" + passage), (2, "盈利情况如何"), (3, other), (4, "无关")]
    cases = [("a", "盈利情况如何", passage, "s"), ("b", "盈利情况如何", other, "s"), ("c", "盈利情况如何", "没有这一段" * 12, "t")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(cases, "case_id string, question string, gold_passage string, section_id string").write.parquet(str(tmp_path / "retrieval_eval_case.parquet"))
    got = {(r.case_id, r.k): (r.hit, r.coverage, r.rr10) for r in queries.search_scores(spark, str(tmp_path)).collect()}
    assert got == {("a", 1): (0, 0.0, 0.5), ("a", 5): (1, 1.0, 0.5), ("a", 10): (1, 1.0, 0.5), **{("b", k): (0, 0.0, 0.0) for k in (1, 5, 10)}}
    assert {(r.section_id, r.k): r.hit for r in queries.search_metrics(spark, str(tmp_path)).collect()}["all", 10] == 0.5


# Arrays and queries -------------------------------------------------------------------------------------------------


def test_kgrams_and_window_min():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 200).astype(np.uint64)
    for k in (1, 2, 3, 5, 7, 20, 40):
        direct = [sum(int(v[i + j]) * pow(arrays.BASE, k - 1 - j, 1 << 64) for j in range(k)) % (1 << 64) for i in range(200 - k + 1)]
        assert arrays.kgrams(v, k).tolist() == direct
        assert arrays.window_min(v, k).tolist() == [v[i : i + k].min() for i in range(200 - k + 1)]
    assert len(arrays.kgrams(v[:3], 5)) == 0


@here
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    columns, ours, theirs = same(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name])
    assert columns and not ours and not theirs


@here
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0
