"""Language ID, toxicity, pieces, SimHash and repeats: defined cases, and results against plain versions."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from topolake.llm import langid, linededup, pieces, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_langid_defined_cases(spark, odd, none):
    order = F.xxhash64("doc_id")
    model = langid.train(odd, order)
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    for r, o in zip(got, odd.collect(), strict=True):
        assert 0 <= r["score"] <= 1
        if not o["text"] or not any(c.isalpha() for c in o["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("de", "en")
    assert langid.identify(none, model).count() == 0
    blank = langid.train(none, order)
    assert {r["lang_pred"] for r in langid.identify(odd, blank).collect()} == {"und"}
    assert langid.annotate(odd, model).columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]


def test_langid_held_out_accuracy(docs):
    model = langid.train(docs.where(~langid.held_out()), F.xxhash64("doc_id"))
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang", langid.held_out().alias("held")), "doc_id").where("held").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.95


def test_langid_corrects_for_false_yes():
    table = np.full((1, langid.LEAST_SLOTS), 3, np.uint8)  # both languages say yes to everything
    model = langid.Model(["a", "b"], table, np.array([0.9, 0.5]), 4)
    lang, score = model.predict(["some words of text"])
    assert lang == ["a"] and score[0] == 1.0


def _plain_grams(text):
    import re

    norm = " " + re.sub(r" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in text)).strip() + " "
    return [norm[i : i + 4] for i in range(len(norm) - 3) if " " not in norm[i + 1 : i + 3]]


def test_langid_filters_match_plain_sets(docs):
    """Each n-gram's mask has all languages whose plain sets hold it, and others only as often as the rate that corrects for it."""
    from collections import Counter

    rows = docs.where("lang is not null and text is not null").select("text", "lang").collect()
    count = {lang: Counter() for lang in {r["lang"] for r in rows}}
    for r in rows:
        count[r["lang"]].update(_plain_grams(r["text"]))
    count = {lang: {g: n for g, n in c.items() if n >= 3} for lang, c in count.items()}
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in count.items()}
    top = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    plain = {lang: {g for g, x in r.items() if x >= 0.2 * top[g]} for lang, r in rate.items()}
    model = langid.train(docs, F.xxhash64("doc_id"), per_lang=10**9)
    assert model.langs == sorted(plain)
    every = sorted(top) + sorted({g for r in docs.limit(100).collect() for g in _plain_grams((r["text"] or "")[::-1])} - set(top))
    hashes = np.array([langid.grams([g.strip()], 4)[0][0 if g[0] == " " else -1 if g[-1] == " " else 1] for g in every])
    mask = model.masks(hashes)[0]
    for bit, lang in enumerate(model.langs):
        says = (mask >> np.uint8(bit)) & 1 == 1
        held = np.array([g in plain[lang] for g in every])
        assert says[held].all() and abs(says[~held].mean() - model.chance[bit]) < 0.02
    # corrected shares come to the plain ones
    texts = [r["text"] for r in rows[:100]]
    lang, score = model.predict(texts)
    for text, got, value in zip(texts, lang, score, strict=True):
        mine = _plain_grams(text)
        share = {k: sum(g in plain[k] for g in mine) / max(1, len(mine)) for k in plain}
        assert got == max(sorted(share), key=share.get) and (len(mine) < 50 or abs(value - share[got]) < 0.06)


def test_langid_text_alone_decides():
    texts = ["abc def.", "", "ghij", "...", "x abc", "word!"]
    h, owner, letters = langid.grams(texts, 4)
    for i, t in enumerate(texts):
        alone, _, n = langid.grams([t], 4)
        assert h[owner == i].tolist() == alone.tolist() and letters[i] == n[0]


def test_langid_more_languages_than_bits_of_a_word(spark):
    rng = random.Random(4)
    word = lambda i: "".join(chr(0x4E00 + 40 * i + rng.randrange(40)) for _ in range(3))
    rows = [(100 * i + j, " ".join(word(i) for _ in range(60)) * 3, f"l{i:03}") for i in range(70) for j in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, F.xxhash64("doc_id"), least=1)
    assert len(model.langs) == 70 and model.table.shape[0] == 2
    assert langid.identify(table, model).join(table, "doc_id").where("lang <> lang_pred").count() == 0


def test_simhash_is_the_bitwise_majority():
    import xxhash

    rng = random.Random(5)
    for n in (1, 2, 3, 4, 40):
        words = [rng.choice(["A", "b", "Cc", "dé", "x"]) for _ in range(n)]
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
        grams = [" ".join(low[i : i + 3]) for i in range(max(1, n - 2))]
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        assert simhash.simhash(" \t".join(words)) == want
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0


def _components(fps, ids, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            root[find(j)] = find(i)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_ball_search_finds_every_link(spark, radius):
    rng = random.Random(radius)
    fps = set()
    for _ in range(60):  # clusters whose members differ in up to four bits, all in one part or spread
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            bits = rng.sample(range(21), rng.randint(0, 4)) if rng.random() < 0.5 else rng.sample(range(64), rng.randint(0, 4))
            fps.add(base ^ sum(1 << b for b in bits))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.edges(df, radius)).collect()}
    want = _components(fps, list(range(len(fps))), radius)
    groups = {}
    for s, w in zip(signed, want, strict=True):
        groups.setdefault(w, []).append(s)
    for members in groups.values():
        assert len({got.get(m, m) for m in members}) == 1
    assert len({got.get(s, s) for s in signed}) == len(groups)


def test_large_meeting_is_a_spanning_forest():
    rng = np.random.default_rng(1)
    keep, _ = simhash._balls(3)[0]
    variant = np.uint64(rng.integers(0, 1 << 63)) & keep
    rest = rng.integers(0, 1 << 21, 900).astype(np.uint64)
    flips = np.array([0, *(1 << b for b in range(21, 64))], np.uint64)
    fps = np.unique(variant ^ flips[rng.integers(0, len(flips), 900)] | (rest & ~keep))
    a, b = simhash.forest(fps, 3, keep, variant)
    x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    want = simhash._roots(len(fps), x, y)
    at = {int(f): i for i, f in enumerate(fps)}
    got = simhash._roots(len(fps), np.array([at[int(f)] for f in a]), np.array([at[int(f)] for f in b]))
    # links with three differences in one part and other members' flips are found under another part
    for g in np.unique(got):
        assert len(set(want[got == g])) == 1


def test_large_meetings_lose_no_link(spark, monkeypatch):
    """The search of large meetings finds the same components as comparing all pairs."""
    monkeypatch.setattr(simhash, "SMALL", 3)
    rng = random.Random(21)
    fps = set()
    for _ in range(6):  # balls around a centre: many members share variants, some are three bits apart within one part
        base = rng.getrandbits(64)
        for _ in range(60):
            bits = rng.sample(range(21), rng.randint(0, 3)) if rng.random() < 0.4 else rng.sample(range(64), rng.randint(0, 5))
            fps.add(base ^ sum(1 << b for b in bits))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    got = {r["node"]: r["root"] for r in simhash.components(simhash.edges(spark.createDataFrame([(s,) for s in signed], "fp long"), 3)).collect()}
    want = _components(fps, list(range(len(fps))), 3)
    pairs = {(w, got.get(s, s)) for s, w in zip(signed, want, strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({g for _, g in pairs})


def test_near_duplicates_match_comparing_all_texts(spark, docs):
    import re

    import xxhash

    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()] + [(1000, ""), (1001, "one two"), (1002, "One\ttwo"), (1003, " \n")]
    table = spark.createDataFrame(rows, "doc_id long, text string")

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [plain(t) for _, t in rows]
    least = _components(prints, [i for i, _ in rows], 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table).collect()}
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, prints, least, strict=True)}
    assert len(set(least)) < len(rows)


def test_simhash_defined_cases(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["fingerprint"], set()).add(r["component_id"])
    assert all(len(c) == 1 for c in by.values())
    assert by["0" * 16] == {2}  # null, empty and blank texts link
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 2, 5, 6, 8]
    assert simhash.keep_one(none).count() == 0


def test_pipeline_leaves_no_near_copies(spark, odd, none):
    """Copies with a few words changed differ in more than 3 bits, but share 0.8 of their five-word shingles."""
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(4):
            words = list(base)
            for at in rng.sample(range(120), 2):
                words[at] = "changed"
            rows.append((len(rows), " ".join(words)))
    grams = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in rows}
    near = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table.unionByName(table.limit(3)), SF).collect()}
    assert not any(near(a, b) for a, b in combinations(sorted(kept), 2))
    assert all(i in kept or any(near(i, k) for k in kept if k < i) for i, _ in rows) and len(kept) < len(rows)
    assert corpus_pipeline.near_dedup(spark, odd, SF).columns == odd.columns and corpus_pipeline.near_dedup(spark, none, SF).count() == 0


def _plain_dedup(rows, run_words, line_words):
    """(text without repeats, spans) by doc_id of (doc_id, text), by the words themselves; only the cuts are the operator's."""
    import re

    import xxhash

    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]) for a, b in words]
        found = []  # (what it says, first word, words)
        if words:
            first, size = linededup.cuts(np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in low], np.uint64))
            found += [((tuple(low[a : a + n]), tuple(low[a + n : a + n + m])), a, n + m) for a, n, m in zip(first, size, size[1:], strict=False)]
        at = 0
        for line in text.split("\n"):
            n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
            if n >= line_words:
                found.append((tuple(low[at : at + n]), at, n))
            at += n
        cover = [0] * (len(words) + 1)  # how many marked units hold the gap between a word and the next
        gone = [False] * len(words)
        for what, a, n in found:
            if what in seen:
                gone[a : a + n] = [True] * n
                for i in range(a, a + n - 1):
                    cover[i] += 1
            seen.add(what)
        at, spans = 0, []
        while at < len(words):
            end = at + 1
            while gone[at] and end < len(words) and cover[end - 1]:
                end += 1
            if gone[at] and end - at >= run_words:
                spans.append((at, end))
            at = end
        out[doc] = [text[words[a][0] : words[b - 1][1]] for a, b in spans]
    return out


@pytest.mark.parametrize(("run_words", "line_words"), [(20, 5), (1, 1)])
def test_line_dedup_matches_a_plain_version(spark, docs, run_words, line_words):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None]
    want = _plain_dedup(rows, run_words, line_words)
    texts, some = dict(rows), 0
    for r in linededup.remove_repeats(docs, run_words=run_words, line_words=line_words).collect():
        whole, at, keep = texts[r["doc_id"]], 0, []
        squeeze = lambda parts: "".join("".join(parts).split())
        for x in r["removed"]:
            keep.append(whole[at : x["start"]])
            at = x["end"]
        assert r["text"] == "".join([*keep, whole[at:]])
        assert squeeze(whole[x["start"] : x["end"]] for x in r["removed"]) == squeeze(want[r["doc_id"]])
        some += bool(r["removed"])
    assert some > 5


def test_line_dedup_takes_every_repeated_line_if_asked(spark):
    rows = [(1, "one\ntwo words\nthree of these"), (2, "two words\nelse\nONE"), (3, "else\nother"), (4, "else")]
    got = {r["doc_id"]: r["text"] for r in linededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), run_words=1, line_words=1).collect()}
    assert got == {1: rows[0][1], 2: "else\n", 3: "other", 4: ""}


def test_line_dedup_leaves_short_shared_lines(spark):
    """A footer of a few words that many share is no passage; it goes where it is a part of one."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9)))
    rows = [(i, "\n".join([" ".join(word() for _ in range(50)), "all rights of this page are reserved"])) for i in range(20)]
    again = [(100, "a new start\n" + rows[0][1])]
    got = {r["doc_id"]: r for r in linededup.remove_repeats(spark.createDataFrame(rows + again, "doc_id long, text string")).collect()}
    assert all(got[i]["removed"] == [] for i in range(20)) and len(got[100]["text"].split()) < 20


def test_line_dedup_finds_a_passage_broken_into_other_lines(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9)))
    rows, caught = [], []
    for i in range(20):
        words = [word() for _ in range(60)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, "\n".join([" ".join(words[:13]), " ".join(words[13:33]), " ".join(words[33:])]))]
    for r in linededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r["doc_id"] % 2:
            caught.append(len(r["text"].split()))
        else:
            assert r["removed"] == []
    assert sum(n <= 25 for n in caught) >= 18


def test_line_dedup_catches_passages_in_the_middle_of_lines(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(40)) + f" {passage} " + " ".join(word() for _ in range(30)), "en") for i in range(6)]
    clean = [(100 + i, " ".join(word() for _ in range(120)), "en") for i in range(6)]
    got = {r["doc_id"]: r["removed"] for r in linededup.remove_repeats(spark.createDataFrame(rows + clean, "doc_id long, text string, lang string")).collect()}
    assert got[0] == [] and all(got[i] == [] for i in range(100, 106))
    for i in range(1, 6):
        start = rows[i][1].index(passage)
        hit = sum(max(0, min(x["end"], start + len(passage)) - max(x["start"], start)) for x in got[i])
        assert hit > 0.5 * len(passage)
        assert sum(x["end"] - x["start"] for x in got[i]) < 1.15 * len(passage)


def test_line_dedup_leaves_short_pieces_from_different_places(spark):
    """Two stretches of words that repeat, each in another text, are no repeated passage where they first stand together."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9)))
    rows = []
    for i in range(40):
        texts = [[word() for _ in range(200)] for _ in range(2)]
        rows += [(3 * i + k, " ".join(words)) for k, words in enumerate(texts)]
        rows.append((3 * i + 2, " ".join([word() for _ in range(20)] + texts[0][60:78] + texts[1][90:108] + [word() for _ in range(20)])))
    assert all(r["removed"] == [] for r in linededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_line_dedup_defined_cases(spark, odd, none):
    out = linededup.remove_repeats(odd)
    got = out.collect()
    assert out.columns == [*odd.columns, "removed"] and len(got) == odd.count()
    assert [r["text"] for r in got if r["doc_id"] == 3] == [None]
    same = [(r["text"], r["removed"]) for r in got if r["doc_id"] == 1]
    assert len(same) == 2 and same[0] == same[1] and same[0][1] == []
    assert all(r["removed"] == [] for r in got if r["doc_id"] == 7)  # 16 words are no passage
    assert [r["text"] for r in linededup.remove_repeats(odd, run_words=10).where("doc_id = 7").collect()] == [""]
    assert linededup.remove_repeats(none).count() == 0


def test_pieces_n_best_matches_all_segmentations(spark):
    lattice = pieces.Lattice(open(pieces.MODEL, "rb").read(), 3)

    def every(unit, at=0):
        """(cost, lengths of the pieces from the last one, negated; ids) of all segmentations."""
        if at == len(unit):
            return [(0, (), ())]
        out = []
        if unit[at] not in lattice.arcs:
            cost, ids = lattice.fallback(unit[at])
            out += [(cost + c, (*sizes, -1), (*ids, *x)) for c, sizes, x in every(unit, at + 1)]
        for end in range(at + 1, len(unit) + 1):
            if unit[at:end] in lattice.arcs:
                cost, i = lattice.arcs[unit[at:end]]
                out += [(cost + c, (*sizes, at - end), (i, *x)) for c, sizes, x in every(unit, end)]
        return out

    rng = random.Random(1)
    for _ in range(150):
        unit = " " + "".join(rng.choice("thaeino漢x") for _ in range(rng.randint(1, 8)))
        want = sorted(every(unit.replace(" ", pieces.SPACE)))
        assert lattice.segment(unit, 3) == [(c, ids) for c, _, ids in want[:3]]
        ids, cost, gap = lattice.solve(unit)
        assert (cost, ids) == (want[0][0], want[0][2]) and (len(want) == 1 or gap == want[1][0] - want[0][0])
    # whole texts: sums of one choice a unit, ids one after another
    for text in ["that hat none", "hat", "to the inn", "a 漢 x\nthe", "tin  tin"] + [" ".join("".join(rng.choice("thaeino") for _ in range(rng.randint(1, 5))) for _ in range(3)) for _ in range(20)]:
        want = [(0, ())]
        for unit in pieces._UNITS.findall(" " + text):
            want = sorted(((a + c, (*x, *y)) for a, x in want for c, _, y in every(unit.replace(" ", pieces.SPACE))), key=lambda w: w[0])[:60]
        got = lattice.encode(text)
        assert [round(-s * pieces.UNIT) for s, _ in got] == [c for c, _ in want[:3]]
        least = {c for c, _ in want[:3]}
        assert {(round(-s * pieces.UNIT), tuple(ids.tolist())) for s, ids in got} <= {w for w in want if w[0] in least}
        assert len({tuple(ids.tolist()) for _, ids in got}) == len(got) and all(lattice.decode(ids) == text for _, ids in got)
    table = spark.createDataFrame([(1, "that hat none"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pieces.encode(table).collect()}
    plain = lattice.encode("that hat none")
    assert [rows[1]["ids"], *(x["ids"] for x in rows[1]["others"])] == [ids.tolist() for _, ids in plain] and [x["score"] for x in rows[1]["others"]] == [s for s, _ in plain[1:]]
    assert rows[2]["ids"] == [] and rows[2]["others"] == [] and rows[3]["ids"] is None and rows[3]["others"] is None
    hashed = {r["doc_id"]: r for r in pieces.encode(table, digest=True).collect()}
    import hashlib

    assert [x["ids_sha256"] for x in hashed[1]["others"]] == [hashlib.sha256(np.array(x["ids"], "<i4").tobytes()).hexdigest() for x in rows[1]["others"]]


def test_pieces_round_trip(spark, odd, none, docs):
    odd_text = spark.createDataFrame([(1, "a ▁b  c\n\n\td 漢𓀀 </s><s> \x00end "), (2, ""), (3, None), (4, " "), (5, "\n"), (6, "é" * 5000)], "doc_id long, text string")
    for table in (odd_text, odd, docs):
        got = pieces.encode(table, digest=True)
        assert got.where("not exact").count() == 0 and got.count() == table.count()
    back = pieces.decode(pieces.encode(odd_text)).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {r["doc_id"]: r["text"] for r in odd_text.collect()}
    assert pieces.encode(none).count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, (400, 3)).astype(float)
    y = np.digitize(1.5 * x[:, 0] - 0.2 * x[:, 1] + rng.logistic(0, 0.3, 400), [1.0, 2.5])
    rows, cols = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, cols, x[rows, cols], y, 3)
    assert w[0] > 1 and abs(w[2]) < 0.5 and (np.diff(t) > 0).all()
    model = toxicity.Model({"bad": 2.0}, np.array([1.0, 3.0]))
    above = model.grades(["bad", None, "bad bad bad", "good"])
    assert (above[:, 0] >= above[:, 1]).all() and above[2, 0] > above[0, 0] > above[3, 0] == above[1, 0]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    assert (got.toxic[got.y == 1]).mean() > 0.9 and (got.toxic[got.y == 0]).mean() < 0.01


def test_ordinal_fit_is_a_maximum():
    """No small step of a weight or a threshold betters the penalised likelihood, written out row by row."""
    import math

    rng = np.random.default_rng(3)
    x = rng.poisson(0.7, (150, 4)).astype(float)
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1] + rng.logistic(0, 0.7, 150), [0.8, 2.0, 3.0])
    rows, cols = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, cols, x[rows, cols], y, 4, steps=3000, rate=0.02)

    def loss(w, t):
        below = lambda k, s: 1.0 if k == 3 else 0.0 if k < 0 else 1 / (1 + math.exp(s - t[k]))
        out = 0.05 / 2 * sum(v * v for v in w)
        for xi, yi in zip(x, y, strict=True):
            s = sum(a * b for a, b in zip(xi, w, strict=True))
            out -= math.log(below(yi, s) - below(yi - 1, s))
        return out

    best = loss(w, t)
    for i in range(4):
        for d in (-0.05, 0.05):
            assert loss(w + d * np.eye(4)[i], t) > best
    for i in range(3):
        for d in (-0.05, 0.05):
            assert loss(w, t + d * np.eye(3)[i]) > best


def test_toxicity_severity_matches_a_plain_version(spark, docs):
    """Every document's severity, worked out feature by feature from the weights; and more insults are never milder."""
    import math
    import re

    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.train(big, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert len(model.thresholds) >= 2 and (np.diff(model.thresholds) > 0).all()

    def plain(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        s = 0.0
        for f, w in model.weights.items():
            n = sum(x.startswith(f[:-1]) for x in words) if f.endswith("*") else words.count(f)
            s += w * math.log(1 + n)
        above = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        grades = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        return sum(g * k for k, g in enumerate(grades)), max(range(len(grades)), key=grades.__getitem__), above[0] >= 0.5

    some = docs.limit(60)
    got = {r["doc_id"]: r for r in toxicity.score(some, model).collect()}
    for r in some.collect():
        severity, grade, toxic = plain(r["text"])
        assert got[r["doc_id"]]["severity"] == pytest.approx(severity) and (got[r["doc_id"]]["grade"], got[r["doc_id"]]["toxic"]) == (grade, toxic)
    insult = max((f for f in model.weights if not f.endswith("*")), key=model.weights.get)
    worse = model.grades([f"the end {insult} " * k for k in range(6)]).sum(axis=1)
    assert (np.diff(worse) > 0).all() and worse[0] < 0.5 < worse[-1]


def test_toxicity_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i} " + ("awful" if i % 5 == 1 else "fine")) for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(5)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_docs=200)
    assert model.weights["awful"] > 0
    got = toxicity.score(docs, model)
    assert got.count() == 2000 and got.where("toxic").select("doc_id").distinct().collect()[0][0] == 1


def test_grades_come_from_other_documents():
    y = np.array([0, 1, 1, 1, 1, 1, 1])
    assert toxicity.grades_of(y, np.array([9.0, 0, 1, 2, 3, 4, 5])).tolist() == [0, 1, 1, 2, 2, 3, 3]
    assert toxicity.grades_of(y, np.zeros(7)).tolist() == [0, 1, 1, 1, 1, 1, 1]


def test_toxicity_defined_cases(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels, least_z=0.1)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    empty = toxicity.train(odd, labels.limit(0))
    assert {r["toxic"] for r in toxicity.score(odd, empty).collect()} == {False}
