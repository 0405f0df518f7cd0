"""Pieces, spans, alignment, mixing."""

import random
from collections import defaultdict

import numpy as np
import pytest

from storyloom.llm import align, mixing, pieces, spans


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- pieces --------------------------------------------------------------------------------------------------------
CHUNK = "chunk_id bigint, item_id bigint, text_offset bigint, text string, n_chars int"


def chunks(spark, items):
    out, k = [], 0
    for item, text in items.items():
        rng = random.Random(item)
        at = 0
        while at < len(text):
            end = min(len(text), at + rng.randint(1, 400))
            back = rng.choice([0, 0, 5])
            out.append((k, item, max(0, at - back), text[max(0, at - back) : end], 0))
            k, at = k + 1, end
        out.append((k, item, 0, None, 0))
        k += 1
    rng.shuffle(out)
    return spark.createDataFrame(out + out[:3], CHUNK)


ITEMS = {
    1: "short text", 2: "x" * 801, 3: "a b " * 400, 4: "y" * 1000 + " " + "z" * 2000 + "。" + "q" * 30, 5: "😀一。" * 700, 6: "w" * 800, 7: ("word " * 50 + "\n\n") * 9,
}


@pytest.mark.parametrize("block,margin", [(1 << 16, 1 << 13), (1000, 900), (801, 801)])
def test_long_stretches(spark, block, margin):
    expected = []
    for item, text in ITEMS.items():
        if len(text) > 800:
            long = [(item, a) for a, b in pieces.stretches(text) if b - a > 800]
            expected += long or [(item, -1)]
    assert rows(pieces.long_stretches(chunks(spark, ITEMS), block=block, margin=margin)) == sorted(expected, key=repr)


@pytest.mark.parametrize("block,margin", [(1 << 16, 1 << 13), (2000, 900)])
def test_pieces_cover_items(spark, block, margin):
    by = defaultdict(list)
    for r in pieces.pieces(chunks(spark, ITEMS), block=block, margin=margin).collect():
        by[r.item_id].append(r)
    for item, text in ITEMS.items():
        at = 0
        for r in sorted(by[item], key=lambda r: r.text_offset):
            assert len(r.text) == r.n_chars <= 800 and 0 <= r.shared <= 80
            assert r.text == text[r.text_offset : r.text_offset + r.n_chars] and r.text_offset + r.shared == at
            at = r.text_offset + r.n_chars
        assert at == len(text)
    assert len(by[1]) == len(by[6]) == 1


def test_weak_boundaries_go_first():
    text = ("aaaa bbbb. " * 10 + "\n") * 12
    cuts = [p.end for p in pieces.cut(text)]
    assert all(text[c - 1] == "\n" for c in cuts[:-1])


def test_piece_edges(spark):
    df = spark.createDataFrame([(1, None, 0, "x", 0), (2, 1, None, "x", 0), (3, 2, 5, "x", 0), (4, 3, 0, "", 0)], CHUNK)
    assert [(r.item_id, r.text) for r in pieces.pieces(df).collect()] == [(2, "�" * 5 + "x")]
    assert pieces.long_stretches(df).count() == 0 and pieces.pieces(df.limit(0)).count() == 0


# --- spans ---------------------------------------------------------------------------------------------------------
def brute(texts, n):
    held = defaultdict(set)
    for i, t in texts.items():
        for p in range(len(t) - n + 1):
            held[t[p : p + n]].add(i)
    pairs, shared = set(), {w for w, s in held.items() if len(s) > 1}
    for w in shared:
        s = sorted(held[w])
        pairs |= {(a, b) for k, a in enumerate(s) for b in s[k + 1 :]}
    cover = {i: len({q for p in range(len(t) - n + 1) if t[p : p + n] in shared for q in range(p, p + n)}) for i, t in texts.items()}
    return pairs, cover


def corpus(spark, texts):
    r = spark.createDataFrame([(i, f"d{i}", None if i % 2 else "same") for i in texts], "record_id bigint, document_id string, display_title string")
    out, k = [], 0
    for i, t in texts.items():
        for n, line in enumerate(t.split("\n")):
            out.append((k, f"d{i}", n + 1, line or None))
            k += 1
    out += [(k + 1, f"d{i}", 1, "a later delivery") for i in list(texts)[:2]]
    return r, spark.createDataFrame(out, "line_id bigint, document_id string, line_number int, text string")


@pytest.mark.parametrize("budget", [2000, 3])
def test_spans_against_brute_force(spark, budget):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé一😀 \n") for _ in range(n))
    common = [word(n) for n in (120, 119, 121, 300, 60)]
    texts = {}
    for i in range(1, 40):
        texts[i] = word(rng.randint(0, 400)) + rng.choice([*common, ""]) + word(rng.randint(0, 200)) + rng.choice([*common, "", ""])
    texts[50] = texts[51] = texts[3] + "x" * 130
    texts[52] = "a" * 500
    texts[53] = "b" + "a" * 130 + "c"
    texts[54] = texts[55] = "short"
    texts[56] = ""
    texts = {i: t.strip("\n") for i, t in texts.items()}
    r, lines = corpus(spark, texts)
    pairs, cover = brute(texts, 120)
    assert {tuple(x) for x in spans.found(r, lines, budget=budget).collect()} == pairs
    assert {x.record_id: x.shared_chars for x in spans.coverage(r, lines, budget=budget).collect()} == cover
    parts = defaultdict(list)
    for x in sorted(spans.stretches(r, lines, budget=budget).collect()):
        assert x.end_pos - x.start_pos >= 120 and (not parts[x.record_id] or parts[x.record_id][-1] < x.start_pos)
        parts[x.record_id] += [x.start_pos, x.end_pos]


def test_long_texts_in_time_and_deep_tops(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    # one boilerplate in all records, going on in ways that part again and again
    boiler = "".join(rng.choice("pqrst") for _ in range(100))
    texts = {1: "x" + long, 2: long + "y"}
    for i in range(3, 60):
        n = rng.choice([0, 5, 10, 19, 20, 21, 40])
        texts[i] = f"{i} " + "".join(rng.choice("uv") for _ in range(30)) + "z" * rng.choice([0, 10, 25]) + boiler + "w" * n + f" {i}"
    r, lines = corpus(spark, texts)
    few = {i: t for i, t in texts.items() if i > 2}
    pairs, cover = brute(few, 120)
    for budget in (5, 2000):
        assert {tuple(x) for x in spans.found(r, lines, budget=budget).collect()} == pairs | {(1, 2)}
        got = {x.record_id: x.shared_chars for x in spans.coverage(r, lines, budget=budget).collect()}
        assert got == cover | {1: 200_000, 2: 200_000}


def test_hot_group_of_copies(spark):
    text = "all of these say the same " * 8
    texts = {i: (text if i % 3 else f"{i} {text} {i}") for i in range(1, 31)}
    r, lines = corpus(spark, texts)
    assert spans.found(r, lines).count() == 30 * 29 // 2


def test_tree_nodes():
    got = {(d, tuple(sorted(m))) for d, m in spans.tree_nodes(["abcx", "abcy", "abz", "q", "abcx"], 2)}
    assert got == {(2, (0, 1, 2, 4)), (3, (0, 1, 4)), (4, (0, 4))}


def test_spans_of_nothing(spark):
    r, lines = corpus(spark, {1: "x" * 200, 2: "y"})
    assert spans.found(r.limit(0), lines.limit(0)).count() == 0
    got = spans.coverage(r, lines.limit(0)).collect()
    assert {(x.n_chars, x.shared_chars) for x in got} == {(0, 0)} and len(got) == 2


# --- alignment -----------------------------------------------------------------------------------------------------
SUBJECTS, VERBS, THINGS = [(f"sub{chr(97 + k)}x", chr(0x4E00 + k) + chr(0x4F00 + k)) for k in range(12)], [(f"verb{chr(97 + k)}y", chr(0x5000 + k) + chr(0x5100 + k)) for k in range(12)], [(f"thing{chr(97 + k)}z", chr(0x5200 + k) + chr(0x5300 + k)) for k in range(15)]


def parallel(seed, n):
    """A made-up document: true pairs of two made-up languages with omissions, merges and moves."""
    rng = random.Random(seed)
    said = [(rng.choice(SUBJECTS), rng.choice(VERBS), rng.choice(THINGS), rng.randint(100, 9999) if rng.random() < 0.6 else None) for _ in range(n)]
    en = lambda s: f"{s[0][0]} {s[1][0]} the {s[2][0]}" + (f" {s[3]:,} times" if s[3] else "")
    cn = lambda s: f"{s[0][1]}{s[1][1]}了{s[2][1]}" + (f"{s[3]}次" if s[3] else "")
    order = list(range(n))
    if n > 4 and rng.random() < 0.5:
        order.insert(rng.randrange(n), order.pop(rng.randrange(n)))
    a, b, pairs, k = [], [], set(), 0
    place = {}
    for i in range(n):
        if rng.random() < 0.1 and i + 1 < n:
            continue
        place[i] = len(a)
        a.append(cn(said[i]) + "。")
    while k < n:
        group = [order[k]]
        if rng.random() < 0.15 and k + 1 < n:
            group.append(order[k + 1])
        if rng.random() > 0.1 or len(group) > 1:
            pairs |= {(place[i], len(b)) for i in group if i in place}
            b.append("; ".join(en(said[i]) for i in group) + ".")
        k += len(group)
    return a, b, pairs


def test_alignment_of_made_up_documents(spark):
    i18n, catalogue, truth, row = [], [], set(), 0
    for d in range(120):
        a, b, pairs = parallel(d, 9)
        ids = {}
        for lang, rows_ in ((["CN", "zh", "cn"][d % 3], a), ("En", b)):
            at = 0
            for k, t in enumerate(rows_):
                i18n.append((row, f"t{d}", lang, at, t))
                if k == 0:
                    i18n.append((row + 100_000, f"t{d}", lang, at, t))  # a redelivery
                ids[lang == "En", k] = row
                row, at = row + 1, at + len(t) + 1
        catalogue.append((f"t{d}", ["EN", "CN"] if d % 2 else ["CN", "EN"]))
        truth |= {tuple(sorted((ids[False, x], ids[True, y]))) for x, y in pairs}
    i = spark.createDataFrame(i18n, "row_id bigint, text_id string, lang string, text_offset bigint, text string")
    c = spark.createDataFrame(catalogue, "text_id string, languages array<string>")
    got = {tuple(r) for r in align.found(i, c).collect()}
    right = len(got & truth)
    assert right / len(truth) > 0.93 and right / len(got) > 0.93


def test_alignment_edges(spark):
    i = spark.createDataFrame([(1, "t", "CN", 0, None), (2, None, "CN", 0, "x"), (3, "t", "EN", 0, "x"), (4, "u", "CN", 0, "12345个"), (5, "u", "EN", 0, "12,345 pieces"), (6, "u", "FR", 0, "12345"), (7, "v", "EN", 0, "")], "row_id bigint, text_id string, lang string, text_offset bigint, text string")
    c = spark.createDataFrame([("t", ["CN", "EN"]), ("u", ["CN", "EN"]), ("v", ["EN", "EN"]), ("w", None)], "text_id string, languages array<string>")
    assert rows(align.found(i, c)) == [(4, 5)]
    assert align.found(i.limit(0), c).count() == 0 and align.found(i, c.limit(0)).count() == 0


def test_long_documents_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 20)
    monkeypatch.setattr(align, "REACH", 15)
    a = [f"{k + 1000}号" for k in range(70)]
    b = [f"number {k + 1000}" for k in range(70)]
    i = spark.createDataFrame([(k, "t", "CN", k, x) for k, x in enumerate(a)] + [(100 + k, "t", "EN", k, x) for k, x in enumerate(b)], "row_id bigint, text_id string, lang string, text_offset bigint, text string")
    c = spark.createDataFrame([("t", ["CN", "EN"])], "text_id string, languages array<string>")
    got = {tuple(r) for r in align.found(i, c).collect()}
    assert got == {(k, 100 + k) for k in range(70)}


def test_moves_over_any_distance_in_long_documents(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 20)
    monkeypatch.setattr(align, "REACH", 15)
    rng = random.Random(4)
    said = [(s, v, t) for s in SUBJECTS for v in VERBS for t in THINGS]
    said = rng.sample(said, 300)
    numbers = {k for k in range(300) if k % 3}
    a = [f"{s[1]}{v[1]}了{t[1]}" + (f"{k + 1000}次" if k in numbers else "") + "。" for k, (s, v, t) in enumerate(said)]
    b = [f"{s[0]} {v[0]} the {t[0]}" + (f" {k + 1000} times" if k in numbers else "") + "." for k, (s, v, t) in enumerate(said)]
    order = list(range(300))
    moved = [3, 4, 90, 150, 201, 280]  # 3, 90, 150 and 201 hold no number
    for k, to in zip(moved, (200, 201, 260, 10, 30, 100)):
        order.remove(k), order.insert(to, k)
    i = spark.createDataFrame([(k, "t", "CN", k, x) for k, x in enumerate(a)] + [(1000 + k, "t", "EN", n, b[k]) for n, k in enumerate(order)], "row_id bigint, text_id string, lang string, text_offset bigint, text string")
    c = spark.createDataFrame([("t", ["CN", "EN"])], "text_id string, languages array<string>")
    got = {tuple(r) for r in align.found(i, c).collect()}
    truth = {(k, 1000 + k) for k in range(300)}
    assert {(k, 1000 + k) for k in moved} <= got
    assert len(got & truth) > 285 and len(got - truth) < 15


def test_statistics_over_all_sentences(spark):
    said = [(s, v, t) for s in SUBJECTS for v in VERBS for t in THINGS[:6]]
    rows_, row = [], 0
    for d in range(0, len(said), 6):
        for n, (s, v, t) in enumerate(said[d : d + 6]):
            number = 1000 + d + n if (n // 2 + d // 6) % 2 else None  # half have no number, and end in words met there only
            rows_.append((row, f"t{d}", "CN", n, f"{s[1]}{v[1]}了{t[1]}" + (f"{number}次" if number else "甲乙")))
            rows_.append((row + 1, f"t{d}", "EN", n, f"{s[0]} {v[0]} the {t[0]}" + (f" {number} times" if number else " upon opal")))
            row += 2
    i = spark.createDataFrame(rows_, "row_id bigint, text_id string, lang string, text_offset bigint, text string")
    c = spark.createDataFrame([(f"t{d}", ["CN", "EN"]) for d in range(0, len(said), 6)], "text_id string, languages array<string>")
    for most in (align.FIT_PAIRS, 50):
        forth, back = align.models_of(align.tokenised(align.sentences_of(i, c)), most)["CN>EN"]
        share = lambda model, token: tuple(float(x[0]) for x in model.known(np.array([align.token_id(token)])))
        assert share(forth, "opal") == (0.5, 0.5) and share(forth, "the") == (1.0, 1.0) and share(forth, "times") == (0.5, 1.0)
        assert share(back, "甲") == (0.5, 0.5)
        assert abs(sum(forth.jumps) + forth.far - 1) < 1e-9 and forth.jumps[0] > 0.7 and 0 < forth.null < 0.2


def plain_fit(pairs):
    """(given, token) -> chance by expectation maximisation with dictionaries, for keys met twice."""
    t = {(g, e): 1.0 for x, y in pairs for g in [0, *x] for e in y}
    often = {k: 0 for k in t}
    for x, y in pairs:
        for k in ((g, e) for g in [0, *x] for e in y):
            often[k] += 1
    for _ in range(align.ROUNDS):
        counts, whole = dict.fromkeys(t, 0.0), {}
        for x, y in pairs:
            for e in y:
                total = sum(t[g, e] for g in [0, *x])
                for g in [0, *x]:
                    counts[g, e] += t[g, e] / total
        for (g, _e), n in counts.items():
            whole[g] = whole.get(g, 0.0) + n
        t = {k: n / whole[k[0]] for k, n in counts.items()}
    return {k: v for k, v in t.items() if v >= align.FLOOR and often[k] >= 2 and k[0]}


def test_models_are_fitted_on_all_pairs_and_texts(spark, monkeypatch):
    rng = random.Random(6)
    rare = [(f"rare{chr(97 + k)}w", chr(0x6000 + k)) for k in range(20)]
    once = {d: rare[k] for k in range(20) for d in (2 * k, 200 + 11 * k)}  # each of these words is met in two texts
    rows_, row, written = [], 0, []
    for d in range(432):
        s, v, t = rng.choice(SUBJECTS), rng.choice(VERBS), rng.choice(THINGS)
        en, cn = once.get(d, ("", ""))
        written.append((f"{s[1]}{v[1]}{t[1]}{cn}", f"{s[0]} {v[0]} the {t[0]} {en}"))
        for lang, text in (("CN", f"{written[-1][0]}{1000 + d}次"), ("EN", f"{written[-1][1]} {1000 + d} times")):
            rows_.append((row, f"t{d}", lang, 0, text))
            row += 1
        if d % 4 == 0:
            rows_.append((row, f"t{d}", "EN", 1, f"{d + 5000} unrelated"))
            row += 1
    i = spark.createDataFrame(rows_, "row_id bigint, text_id string, lang string, text_offset bigint, text string")
    c = spark.createDataFrame([(f"t{d}", ["CN", "EN"]) for d in range(432)], "text_id string, languages array<string>")
    tokens = align.tokenised(align.sentences_of(i, c))
    few, many = (align.models_of(tokens, most)["CN>EN"] for most in (50, align.FIT_PAIRS))
    ids = align.Ids()
    pairs = [([ids[x] for x in cn + "次"], [ids[x] for x in [*en.split(), "times"]]) for cn, en in written]
    for way, (one, other) in enumerate(zip(few, many)):
        learned = {(int(g), int(t)): c for k, g in enumerate(one.lexicon.given) for t, c in zip(*(a[one.lexicon.starts[k] : one.lexicon.starts[k + 1]] for a in (one.lexicon.tokens, one.lexicon.chances)))}
        for en, cn in rare:
            assert ((ids[cn], ids[en]) if way == 0 else (ids[en], ids[cn])) in learned
        wanted = plain_fit([p if way == 0 else p[::-1] for p in pairs])
        assert learned.keys() == wanted.keys() and all(abs(learned[k] - wanted[k]) < 1e-5 for k in wanted)
        assert all(np.allclose(x, y, atol=1e-5) for x, y in ((one.lexicon.given, other.lexicon.given), (one.lexicon.tokens, other.lexicon.tokens), (one.lexicon.chances, other.lexicon.chances)))
        # sentences without a partner are counted over all texts: 108 of 540 in English, none in Chinese
        assert abs(one.null - ((108, 0)[way] + align.PRIOR * align.FIRST_NULL) / ((540, 432)[way] + align.PRIOR)) < 1e-9
    monkeypatch.setattr(align, "DENSE", 0)
    monkeypatch.setattr(align, "PIECE", 13)
    sides = [np.array([0, 4, 6, 0, 4, 8]), np.array([3, 3]), np.array([0, 2, 0, 2, 10]), np.array([2, 3])]
    keys, at, column, starts, wide = align._links(*sides)
    links = [(x, y) for xs, ys in (((0, 4, 6), (0, 2)), ((0, 4, 8), (0, 2, 10))) for x in xs for y in ys]
    assert [(int(k) >> 31, int(k) & (1 << 31) - 1) for k in keys[at]] == links and sides[2][column].tolist() == [y for _, y in links]
    assert starts.tolist() == [0, 2, 4, 6, 9, 12] and wide.tolist() == [2, 2, 2, 3, 3, 3]
    fits = []
    for piece in (13, 1 << 18):  # DENSE and PIECE are read where the tasks are made
        monkeypatch.setattr(align, "PIECE", piece)
        fits.append(align._fitted(align.anchored(tokens), tokens, 100))
    assert all(np.allclose(x[c], y[c], atol=1e-5) for x, y in zip(*fits) for c in ("given", "token", "chance", "units", "met"))


# --- mixing --------------------------------------------------------------------------------------------------------
def test_sainte_lague_against_plain_quotients():
    rng = random.Random(1)
    for _ in range(60):
        votes = [rng.choice([0, rng.random(), rng.random() * 9]) for _ in range(rng.randint(1, 7))]
        seats = rng.randint(0, 200)
        plain = [0] * len(votes)
        for _ in range(seats if any(votes) else 0):
            k = max(range(len(votes)), key=lambda k: (votes[k] / (2 * plain[k] + 1), -k))
            plain[k] += 1
        assert mixing.sainte_lague(votes, seats) == plain
    assert mixing.sainte_lague([1, 1], 10, [2, 3]) == [2, 3] and mixing.sainte_lague([], 3) == []


DOC = "doc_id bigint, source string, text string, tokens int"
TARGET = "mix_id string, source string, target_share double, max_repeats int"


def test_mix_meets_shares_and_caps(spark):
    rng = random.Random(2)
    docs = [(k, rng.choice(["big"] * 8 + ["mid"] * 3 + ["small"]), "word " * rng.randint(1, 60), 0) for k in range(1500)]
    docs += [(9000, None, "x", 0), (9001, "big", None, 0), (9002, "mid", "", 0)]
    d = spark.createDataFrame(docs, DOC)
    t = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 4), ("n", "big", 0.9, 3), ("n", "gone", 0.1, 3), ("e", "gone", 1.0, 1)], TARGET)
    got = {(r.mix_id, r.source): r for r in mixing.shares(d, t).collect()}
    for key, share in {("m", "big"): 0.5, ("m", "mid"): 0.3, ("m", "small"): 0.2, ("n", "big"): 1.0}.items():
        assert abs(got[key].actual_share - share) < 0.01, key
        assert got[key].most_times <= got[key].max_repeats
    assert (got["n", "gone"].remark, got["n", "gone"].due_share) == ("absent", 0) and (got["n", "big"].remark, got["n", "big"].due_share) == ("raised", 1)
    assert got["m", "big"].remark == "" and got["m", "big"].due_share == 0.5
    assert got["n", "gone"].tokens == 0 and got["e", "gone"].actual_share == 0
    again = rows(mixing.draw(d, t))
    assert again == rows(mixing.draw(d.repartition(7), t)) and len({r[:3] for r in again}) == len(again)


def test_blocks_of_many_shards_are_drawn_whole(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 900)
    docs = [(k, "ab"[k % 4 == 0], "word " * (k % 50 + 1), 0) for k in range(800)] + [(9999, "b", "word " * 4000, 0)]
    d = spark.createDataFrame(docs, DOC)
    t = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 3)], TARGET)
    got = {r.source: r for r in mixing.shares(d, t).collect()}
    assert all(abs(r.actual_share - 0.5) < 0.06 and r.most_times <= r.max_repeats for r in got.values())
    once = {(r.source, r.doc_id): r.times for r in mixing.draw(d, t, blocks=40).collect()}
    assert max(once.values()) <= 3 and once == {(r.source, r.doc_id): r.times for r in mixing.draw(d.repartition(5), t, blocks=40).collect()}


def test_mix_edges(spark):
    d = spark.createDataFrame([(1, "a", "one two three", 0)], DOC)
    t = spark.createDataFrame([("m", "a", 1.0, 2), ("m", None, 0.5, 1), ("x", "a", None, 1), ("y", "a", -1.0, 1), ("z", "a", 1.0, 0)], TARGET)
    assert [(r.mix_id, r.doc_id, r.times) for r in mixing.draw(d, t).collect()] == [("m", 1, 2)]
    assert mixing.draw(d.limit(0), t).count() == 0 and mixing.draw(d, t.limit(0)).count() == 0
    twice = spark.createDataFrame([("m", "a", 1.0, 2), ("m", "a", 1.0, 2)], TARGET)
    with pytest.raises(ValueError, match="twice"):
        mixing.draw(d, twice)
