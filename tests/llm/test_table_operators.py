"""WARC, chat, I-Match, mixing, search and the pipeline: defined cases, and results against plain versions."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from topolake.llm import bm25, chat, imatch, mixing, queries, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/b c", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "<p>ü</p>"), (5, "x\ny", "é" * 700_000), (2, "again", "<p>same</p>"), (2, "other", "two")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def test_warc_round_trip(spark, pages):
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(got) == pages.count()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for r in pages.collect():
        first[r["html"] or ""] = max(first.get(r["html"] or "", -1), r["page_id"] if r["page_id"] is not None else -1)
    want = sorted((r["page_id"] or -1, len((r["html"] or "").encode()), sha(r["html"]), "response" if (r["page_id"] if r["page_id"] is not None else -1) == first[r["html"] or ""] else "revisit") for r in pages.collect())
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in got) == want
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {2, 4}


def test_warc_smaller_payloads_are_all_responses(spark, pages):
    got = warc.read_archives(warc.write_archives(pages, least=12)).collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_warc_files_are_records_of_their_own(spark, pages):
    manifest = warc.write_archives(pages).collect()
    for m in manifest:
        with open(m["file"], "rb") as f:
            f.seek(m["start"])
            record = gzip.decompress(f.read(m["length"]))
        head, _, block = record.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert len(block) - 4 == int(re.search(rb"Content-Length: (\d+)", head)[1])


def test_warc_chunks(spark, pages, monkeypatch):
    size = 1000
    rows = warc.chunk_table(pages, size).where("page_id = 5").orderBy("chunk_no").collect()
    assert max(len(r["data"]) for r in rows) <= size and b"".join(r["data"] for r in rows).decode() == "é" * 700_000
    assert [r["so_far"] for r in rows][-1] == 1_400_000 and [bool(r["digest"]) for r in rows].count(True) == 1
    back = warc.read_chunks(warc.write_archives(pages, size=size), size=size).where("page_id = 5").orderBy("chunk_no").collect()
    assert max(len(r["data"]) for r in back) <= size and b"".join(r["data"] for r in back).decode() == "é" * 700_000
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_no_cell_holds_a_payload(spark):
    """Of a payload of thousands of chunks nothing larger than one crosses to Python, on the way in or back."""
    size = 512
    html = spark.range(3).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.repeat(F.lit("abcdefghij"), 300_000).alias("html"))
    table = warc.chunk_table(html, size)
    most = table.agg(F.max(F.octet_length("data")).alias("most"), F.count(F.lit(1)).alias("n")).first()
    assert most["most"] == size and most["n"] == 3 * -(-3_000_000 // size)
    plan = table._jdf.queryExecution().toString()
    assert "payload" not in plan
    got = warc.read_chunks(warc.write_archives(html, size=size), size=size)
    assert got.agg(F.max(F.octet_length("data"))).first()[0] <= size
    assert got.where("digest is not null").select("so_far").distinct().collect()[0][0] == 3_000_000


def test_warc_payloads_that_many_share(spark, monkeypatch):
    """The same records whether a payload counts as frequent or not."""
    rows = [(i, None, "" if i % 3 == 0 else f"p{i % 7}") for i in range(200)] + [(None, None, ""), (7, "u", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = {}
    for i, _, h in rows:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    want = sorted((-1 if i is None else i, None if i == first[h or ""] else first[h or ""]) for i, _, h in rows)
    for share in (1, 4, 10_000):
        monkeypatch.setattr(warc, "SHARE", share)
        got = warc.read_archives(warc.write_archives(table)).collect()
        assert sorted((-1 if r["page_id"] is None else r["page_id"], r["refers_to"]) for r in got) == want


def test_chat_escape_is_reversible_and_hides_marks():
    rng = random.Random(2)
    alphabet = [*chat.CONTROL, "<", "\\", "|im_end|>", "[", "a", "\n", "/INST]"]
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        held = chat.escape(text)
        assert chat.unescape(held) == text and not any(c in held for c in chat.CONTROL)
    assert chat.escape("plain text") == "plain text"


def test_chat_folds_deltas_edits_and_regenerations(spark):
    e = [("start", "user", None), ("delta", None, "Hel"), ("delta", None, "lo"), ("end", None, None)]
    log = [(1, i, "m1", *x) for i, x in enumerate(e)] + [
        (1, 10, "m2", "start", "assistant", None), (1, 11, "m2", "delta", None, "bad"), (1, 12, "m2", "regenerate", None, None), (1, 13, "m2", "delta", None, "go"), (1, 14, "m2", "delta", None, "od"),
        (1, 15, "m3", "start", "assistant", None), (1, 16, "m3", "delta", None, "x"), (1, 17, "m3", "edit", None, "</s>"), (1, 18, "m4", "start", "user", None), (1, 19, "m4", "retract", None, None), (1, 20, "none", "delta", None, "lost"),
        (None, 0, "m", "start", None, None), (2, 0, "z", "delta", None, "never opened"),
    ]
    pieces = chat.format_events(spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string"))
    text = {r["conv_id"]: r["text"] for r in pieces.collect()}
    assert text[1] == "<|im_start|>user\nHello<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>assistant\n<\\/s><|im_end|>\n"
    assert set(text) == {1, None}
    got = {r["conv_id"]: r for r in chat.read_back(pieces).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 8 and got[1]["loss_sha256"] == hashlib.sha256(b"good</s>").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nHello\nassistant\ngood\nassistant\n</s>\n").hexdigest()


def test_chat_long_turns_leave_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 50)
    turns = spark.createDataFrame([(1, 0, "assistant", "ab<s>" * 40), (1, 0, "assistant", ""), (1, 1, None, None)], "conv_id long, turn long, role string, text string")
    out = list(chat.turns_of([(1, t[i : i + 50], [{"start": max(s - i, 0), "end": min(e - i, 50)}] if s < i + 50 and e > i else []) for t, (s, e) in [chat.render("assistant", "ab<s>" * 40)] for i in range(0, len(t), 50)]))
    assert out == [(1, "assistant", "ab<s>" * 40, "ab<s>" * 40, len(chat.render("assistant", "ab<s>" * 40)[0]))]
    r = chat.read_back(chat.format_events(chat.events_of(turns))).collect()[0]
    assert r["n_turns"] == 3 and r["loss_chars"] == 200


def test_chat_defined_cases(spark):
    """Nulls, ties, repeats, clashing columns, an empty table, and logs with every kind of event, against plain turns."""
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, None]), rng.choice(["user", "assistant", "a\nb", None]), rng.choice(["", None, "hi <|im_end|> there", "x" * 40, "é漢"])) for _ in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit("clash"), "message": F.lit(1), "kind": F.lit(None).cast("string"), "rn": F.lit(7), "piece": F.lit(0)})
    log = chat.events_of(table)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate", "retract", "end"}
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_events(log.withColumn("mask", F.lit(0)))).collect()}
    low = lambda x: (x is not None, x or "")
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: ((r[1] is not None, r[1] or 0), low(r[2]), (r[3] or "").encode()))
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256("".join(r[3] or "" for r in mine if r[2] == "assistant").encode()).hexdigest()
    assert chat.read_back(chat.format_events(chat.events_of(table.limit(0)))).count() == 0


def test_chat_fold_lets_go_of_what_is_done():
    events = [(1, "a", "start", "user", None), (1, "a", "delta", None, "x"), (1, "b", "start", "user", None), (1, "b", "delta", None, "y"), (1, "b", "end", None, None), (1, "b", "delta", None, "late"), (1, "a", "retract", None, None)]
    stream = chat.fold(iter([*events, (1, "c", "start", "user", None), (1, "c", "delta", None, "z")]))
    assert next(stream) == (1, "user", "y") and list(stream) == [(1, "user", "z")]
    seen = iter([*events, *[(1, "a", "start", "user", "")]])
    assert next(chat.fold(seen)) == (1, "user", "y") and next(seen)[1] == "a"  # b left before the log went on


def test_chat_reads_turns_across_pieces_of_any_size():
    turns = [("user", "a<|im_end|>b"), ("assistant", ""), ("assistant", "xyz" * 5), ("", "q")]
    text, spans, at = "", [], 0
    for role, t in turns:
        turn, loss = chat.render(role, t)
        spans += [(len(text) + loss[0], len(text) + loss[1])] if loss else []
        text += turn
    for size in (1, 2, 7, 10, 11, 30, 1000):
        pieces = [(9, text[i : i + size], [{"start": max(s - i, 0), "end": min(e - i, size)} for s, e in spans if s < i + size and e > i or s == e and i <= s < i + size]) for i in range(0, len(text), size)]
        got = list(chat.turns_of(pieces))
        assert [(r, t) for _, r, t, _, _ in got] == turns and [x for *_, x, _ in got] == [None, "", "xyz" * 5, None]
    import time

    def took(n):
        parts = [chat.render("assistant", "word") for _ in range(n)]
        body, mask, at = "".join(p for p, _ in parts), [], 0
        for p, (s, e) in parts:
            mask.append({"start": at + s, "end": at + e})
            at += len(p)
        start = time.perf_counter()
        assert sum(1 for _ in chat.turns_of([(1, body, mask)])) == n
        return time.perf_counter() - start

    took(2000)
    assert took(32_000) < 40 * max(took(2000), 0.002)


def test_imatch_defined_cases(spark, odd, none):
    got = imatch.with_edits(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == 8 * imatch.SUBSETS
    same = {r["fingerprint"] for r in got if r["doc_id"] in (1, 7)}
    assert len(same) == 1
    assert imatch.with_edits(none).count() == 0
    one = imatch.with_edits(odd.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"x").hexdigest()


def test_imatch_edit_and_order(spark):
    rows = [(i, f"text number {i} " + "ab" * (i % 5)) for i in range(0, 900, 3)]
    got = {r["doc_id"]: r["edited_sha256"] for r in imatch.with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()


@pytest.mark.parametrize("ways", [2, 8])
def test_imatch_many_places(spark, monkeypatch, ways):
    monkeypatch.setattr(imatch, "PLACE_BYTES", 2 * imatch.UNIT)
    monkeypatch.setattr(imatch, "WAYS", ways)
    test_imatch_edit_and_order(spark)


def test_imatch_ids_that_cluster_and_repeat(spark, monkeypatch):
    """A third of the rows without an id and a third of one id, the rest bunched: small places, and every row's next in order."""
    monkeypatch.setattr(imatch, "PLACE_BYTES", 10 * imatch.UNIT)
    monkeypatch.setattr(imatch, "WAYS", 4)
    rows = [(None, f"none {i}") for i in range(200)] + [(5, f"five {i}") for i in range(200)] + [(10**12 + i, f"far {i}") for i in range(150)] + [(i, "same") for i in range(6, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in imatch.placed(docs).groupBy("place").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 80
    got = imatch.neighbours(docs).where("not guest").withColumn("t", F.xxhash64("text")).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["t"]))
    assert [r["following"] for r in order] == [r["text"] for r in order[1:] + order[:1]]
    assert imatch.with_edits(docs).count() == len(rows)


def test_imatch_places_take_as_many_joins_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(imatch, "PLACE_BYTES", 2 * imatch.UNIT)
    plans = [imatch.placed(spark.range(n).selectExpr("id as doc_id", "cast(id as string) as text"))._jdf.queryExecution().executedPlan().toString() for n in (1, 30, 3000)]
    assert len({p.count("BroadcastHashJoin") for p in plans}) == 1


def test_imatch_likeness_of_half_edited_texts(spark):
    """An edit of half a text changes most of what a subset keeps of it; a few sparse subsets stay, and the next document's are others."""
    got = imatch.with_edits(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("over")).first()
    assert got["e"] > 0.12 and got["n"] < 0.02 and got["over"] > 0.7


def test_imatch_subsets_are_the_same_for_all_texts(spark):
    """Every subset decides on a term by the term alone, and all of a text's terms in it are hashed."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choices(words, k=r.choice([3, 30, 150])))) for i in range(80)]
    got = {x["doc_id"]: x["fingerprint"] for x in imatch.with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    df = Counter(w for _, t in rows for w in set(t.split()))
    lexicon = {w for w, n in df.items() if max(2, len(rows) * math.exp(-imatch.IDF_HIGH)) <= n <= len(rows) * math.exp(-imatch.IDF_LOW)}

    def subset(k):
        return {w for w in lexicon if int(hashlib.sha256(w.encode()).hexdigest()[4 * k : 4 * k + 4], 16) < 2 ** (16 - imatch.SPARSE[k])}

    subsets = [subset(k) for k in range(imatch.SUBSETS)]
    head = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
    for i, t in rows:
        kept = [sorted(map(head, set(t.split()) & s)) for s in subsets]
        codes = [hashlib.md5(",".join(map(str, k)).encode()).hexdigest()[:8] if k else "0" * 8 for k in kept]
        if not any(kept):
            codes = [hashlib.md5(b"=" + hashlib.md5(t.encode()).hexdigest().encode()).hexdigest()[:8]] * imatch.SUBSETS
        assert got[i] == "".join(codes)


def test_mixing_targets_and_bounds(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 400])), rng.choices(["s1", "s2", "s3", "s4", None], [50, 20, 10, 1, 5])[0]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    a = mixing.mix(mixing.sized(docs)).toPandas()
    b = mixing.mix(mixing.sized(docs)).toPandas()
    key = lambda p: sorted(zip(p.doc_id, p.taken, strict=True))
    assert key(a) == key(b) and len(a) == 3000
    assert (a.taken <= 3 * a["size"]).all() and (a.taken % a["size"].clip(lower=1) == 0).all()
    by = a.groupby(a.source.fillna("~")).agg(S=("source_size", "first"), T=("target", "first"), taken=("taken", "sum"))
    caps, weights, left, open_ = 3.0 * by.S, dict(zip(["s1", "s2", "s3", "s4", "~"], [5, 2, 1, 5, 2], strict=True)), float(by.S.sum()), set(by.index)
    want = {}
    while open_:  # reshare what full sources leave until none is above
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if caps[s] <= level * weights[s]}
        if not full:
            want |= {s: level * weights[s] for s in open_}
            break
        want |= {s: caps[s] for s in full}
        left -= sum(caps[s] for s in full)
        open_ -= full
    for s in by.index:
        assert by["T"][s] == pytest.approx(want[s])
        assert abs(by.taken[s] - by["T"][s]) <= 400


def test_mixing_rounds_pairs_as_a_plain_pivot_does(spark):
    """One block's pairs by the pivotal method, written out, with the operator's order and random numbers."""
    rng = random.Random(8)
    rows = [(i, "s", rng.randint(1, 60), 1, i, rng.random()) for i in range(40)]
    now = spark.createDataFrame(rows, "doc_id long, source string, size long, rows long, key long, p double").withColumn("rows", F.lit(40).cast("long"))
    place, u = F.xxhash64(F.lit(7), F.lit(0), "doc_id", "size"), mixing._uniform(F.lit(8), F.lit(0), F.col("doc_id"), F.col("size"))
    dealt = now.select("doc_id", "size", "p", place.alias("h"), u.alias("u"), mixing._uniform(F.lit(9), F.col("doc_id"), F.col("size")).alias("last")).orderBy("h").collect()
    want, held = {}, None
    for r in dealt:
        new = {"id": r["doc_id"], "w": r["size"], "p": r["p"], "last": r["last"]}
        if held is None:
            held = new
            continue
        a, b = held, new
        mass_up, mass_down = min(a["w"] * (1 - a["p"]), b["w"] * b["p"]), min(a["w"] * a["p"], b["w"] * (1 - b["p"]))
        moved = mass_up if r["u"] * (mass_up + mass_down) < mass_down else -mass_down
        a["p"] += moved / a["w"]
        b["p"] -= moved / b["w"]
        done, held = (a, b) if min(a["p"], 1 - a["p"]) < 1e-12 else (b, a)
        want[done["id"]] = round(done["p"])
    want[held["id"]] = int(held["last"] < held["p"])
    got = {r["key"]: r["take"] for r in mixing._tree(now, 1, 48, 7).collect()}
    assert got == want


def test_mixing_copies_each_row_its_own_number(spark):
    """Repeated ids and rows: every row as often as drawn for it, whatever other columns are called, and words as targeted."""
    rows = [(i, " ".join(["w"] * (3 if k else 7)), "s" if i % 4 else None) for i in range(200) for k in range(2)] + [(5, "w w w", "s")] * 3 + [(900, "", "s"), (901, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({n: F.lit("clash") for n in ("_row", "_of", "_n", "_copy", "key", "size", "copies", "Taken")})
    out = mixing.copied(docs)
    assert out.columns == docs.columns
    words = out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).where("source is null or source = 's'").collect()
    plan = {r["source"]: r for r in mixing.mix(mixing.sized(docs)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    for r in words:
        assert abs(r["n"] - plan[r["source"]]["target"]) <= 10
    times = {}
    for r in out.collect():
        times[r["doc_id"], r["text"]] = times.get((r["doc_id"], r["text"]), 0) + 1
    assert max(times[k] for k in times if k != (5, "w w w")) <= 3 and mixing.copied(docs.limit(0)).count() == 0


def test_mixing_keeps_expectation(spark):
    docs = spark.createDataFrame([(i, "a", "s" if i % 2 else "t") for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix(mixing.sized(docs), weights=(3, 1)).toPandas()
    first, second = got[got.source == "s"], got[got.source == "t"]
    assert first.taken.sum() == round(first.target.iloc[0]) and second.taken.sum() == round(second.target.iloc[0])


def test_mixing_defined_cases(spark, odd, none):
    got = mixing.mix(mixing.sized(odd))
    assert got.count() == odd.count() and mixing.mix(mixing.sized(none)).count() == 0
    blank = odd.where("doc_id in (2, 3, 4)").where("text is null or trim(text) = ''")
    assert {(r["target"], r["taken"]) for r in mixing.mix(mixing.sized(blank)).collect()} == {(0.0, 0)}


def _plain_search(rows, asked, k):
    import math
    from collections import Counter

    ascii_words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = {i: Counter(ascii_words(t)) for i, t in rows}
    n, mean = len(rows), sum(sum(w.values()) for w in words.values()) / len(rows)
    df = Counter(t for w in words.values() for t in w)
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    for q, text in asked:
        terms = sorted(set(ascii_words(text)))
        scored = []
        for i, w in words.items():
            dl = sum(w.values())
            s = sum(idf[t] * w[t] * (bm25.K1 + 1) / (w[t] + bm25.K1 * (1 - bm25.B + bm25.B * dl / mean)) for t in terms if t in w)
            if s > 0:
                scored.append((-round(s, 6), i))
        yield q, [(i, -s) for s, i in sorted(scored)[:k]]


@pytest.mark.parametrize("shard", [16_384, 37])
def test_search_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(bm25, "SHARD", shard)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in docs.collect()]
    asked = [r for r in rows if r[0] % 50 == 0]
    got = {}
    for r in bm25.search(bm25.build_index(docs), docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for q, want in _plain_search(rows, asked, 10):
        mine = sorted(got[q])
        assert [round(s, 4) for _, _, s in mine] == [round(s, 4) for _, s in want]
        assert [i for _, i, _ in mine] == [i for i, _ in want]


def test_search_skips_blocks(spark, monkeypatch):
    """Blocks whose bound stays under a query's own k-th score are not scored, and the results are those of scoring all."""
    stops = []

    class Counted(bm25._Shard):
        def search(self, *a):
            super().search(*a)
            stops.append((self.visited, self.passed))

    monkeypatch.setattr(bm25, "BLOCK", 16)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in docs.collect()]
    asked = [r for r in rows if r[0] % 50 == 0]
    cache: dict = {}
    every = [bm25.counted(t, cache) for _, t in rows]
    mean = sum(f.sum() for _, f in every) / len(rows)
    flat, at = np.unique(np.concatenate([bm25.counted(t, cache)[0] for _, t in asked]), return_inverse=True)
    size = np.array([len(bm25.counted(t, cache)[0]) for _, t in asked])
    df = np.array([sum(n) for n in zip(*(np.isin(flat, h) for h, _ in every), strict=True)])
    idf = np.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
    scores, found = np.zeros((len(asked), 10)), np.full((len(asked), 10), bm25._LAST)
    for row in bm25.build_index(docs).collect():
        Counted(row.asDict(), flat, idf, mean).search(np.repeat(np.arange(len(asked)), size), at.astype(np.int32), scores, found)
    visited, passed = np.sum(stops, axis=0)
    assert 0 < visited < 0.8 * passed
    for i, (_, want) in enumerate(_plain_search(rows, asked, 10)):
        assert [d for d in found[i].tolist() if d != bm25._LAST] == [d for d, _ in want]


def test_search_ties_over_shards(spark, monkeypatch):
    """Groups of more copies than k, spread over shards of one task whose ids fall: the smallest ids win."""
    monkeypatch.setattr(bm25, "SHARD", 40)
    rows = [(10_000 - i, f"g{i % 20} " * (1 + i % 3) + "common " * (i % 20 % 7) + f"h{i % 20}") for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    asked = [(i, rows[i][1]) for i in range(60)]
    got = {}
    for r in bm25.search(bm25.build_index(docs), spark.createDataFrame(asked, "query_id long, text string"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    for q, want in _plain_search(rows, asked, 5):
        assert [i for _, i in sorted(got[q])] == [i for i, _ in want]


def test_search_defined_cases(spark, odd, none):
    index = bm25.build_index(odd)
    q = odd.select(F.col("doc_id").alias("query_id"), "text")
    got = bm25.search(index, q, k=3).collect()
    assert got and all(r["score"] > 0 for r in got)
    assert bm25.search(bm25.build_index(none), q).count() == 0 and bm25.search(index, q.limit(0)).count() == 0


def test_search_blocks_of_queries(spark, monkeypatch, odd):
    q = odd.select(F.col("doc_id").alias("query_id"), "text")
    one = sorted(map(tuple, bm25.search(bm25.build_index(odd), q, k=3).collect()), key=str)
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 20)
    assert sorted(map(tuple, bm25.search(bm25.build_index(odd), q, k=3).collect()), key=str) == one


def _plain_stages(docs, model):
    """The first three stages over rows (doc_id, text, lang, source), row by row."""
    from collections import defaultdict
    from itertools import combinations

    import xxhash
    from tests.llm.test_text_operators import _components, _plain_dedup

    langs, scores = model.predict([r["text"] for r in docs])
    one = [r for r, lang, score in zip(docs, langs, scores, strict=True) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE]

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]

    def print_of(text):
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams(text)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    one.sort(key=lambda r: r["doc_id"])
    root = _components([print_of(r["text"]) for r in one], [r["doc_id"] for r in one], 3)
    kept, sets = [], []
    for r, least in zip(one, root, strict=True):
        mine = set(grams(r["text"]))
        if least == r["doc_id"] and not any(len(mine & x) >= 0.8 * len(mine | x) for x in sets):
            kept.append(r)
            sets.append(mine)
    gone = _plain_dedup([(r["doc_id"], r["text"]) for r in kept], 20, 5)
    return one, kept, gone


def test_pipeline_stages_match_plain_versions(spark):
    from topolake.llm import langid, pieces

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(9000, "12345 678 !!", None, "s", 12), (9001, "日本語の文章です" * 9, None, "s", 72), (9002, None, "en", "s", None), (9003, docs.first()["text"], None, None, 1)], docs.schema))
    rows = docs.collect()
    one, kept, gone = _plain_stages(rows, langid.learn(docs))
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    first = corpus_pipeline.stored(stages["language ID"](spark, docs, SF), "t1")
    assert first.columns == names and sorted(r["doc_id"] for r in first.collect()) == [r["doc_id"] for r in one] and len(one) < len(rows)
    second = corpus_pipeline.stored(stages["SimHash near-dedup"](spark, first, SF), "t2")
    assert second.columns == names and sorted((r["doc_id"], r["text"]) for r in second.collect()) == sorted((r["doc_id"], r["text"]) for r in kept) and len(kept) < len(one)
    third = corpus_pipeline.stored(stages["substring dedup"](spark, second, SF), "t3")
    text = {r["doc_id"]: r["text"] for r in kept}
    left = {r["doc_id"]: r["text"] for r in third.collect()}
    for doc, cut in gone.items():
        want = len("".join(text[doc].split())) - sum(len("".join(x.split())) for x in cut)
        assert len("".join(left.get(doc, "").split())) == want
    assert third.where("n_chars <> char_length(text)").count() == 0
    fourth = corpus_pipeline.stored(stages["mixing"](spark, third, SF), "t4")
    drawn = {(r["doc_id"], r["copies"]) for r in mixing.mix(mixing.sized(third)).where("copies > 0").collect()}
    assert {(r["doc_id"], r["count"]) for r in fourth.groupBy("doc_id").count().collect()} == drawn and fourth.columns == names
    lattice = pieces.Lattice(open(pieces.MODEL, "rb").read(), 3)
    for r in stages["piece encoding"](spark, fourth, SF).collect():
        want = lattice.encode(left[r["doc_id"]])
        assert [r["ids"], *(x["ids"] for x in r["others"])] == [ids.tolist() for _, ids in want]


def test_pipeline_stages_defined_cases(spark, odd, none):
    """Nulls, repeats, ties and columns of clashing names pass every stage; an empty table gives empty ones."""
    more = {n: F.lit("clash") for n in ("removed", "Lang_Pred", "_t", "_doc", "_thash", "_units", "_row", "_copy", "root", "node", "key", "copies", "bands")}
    base = odd.withColumns(more)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stored(stage(spark, base, SF), "odd")
        assert stage(spark, none, SF).count() == 0
        if i < 4:
            assert out.columns == base.columns and out.dtypes == base.dtypes
            assert {tuple(r[n] for n in (*more, "score", "size", "fp")) for r in out.collect()} <= {tuple(r[n] for n in (*more, "score", "size", "fp")) for r in base.collect()}
        else:
            assert out.count() == base.count()
    got = base
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = corpus_pipeline.stored(stage(spark, got, SF), "odd")
    assert got.columns == base.columns


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES if q.startswith("op")} == set(range(1, 11)) and "pipeline" in __spark_entry__.queries()
