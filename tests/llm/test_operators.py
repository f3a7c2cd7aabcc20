"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import bpe, chat, exact_dedup, licenses, mixing, near_dedup, neighbours, quality, toxicity, warc
from factweave.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)
    # columns whose names the operators use inside
    return df.withColumns({c: F.lit(1) for c in ("h", "norm", "size", "src", "keep_id", "block", "n", "digest", "y", "score")}) if extra else df


ROWS = [(1, "Alpha beta GAMMA delta", "a"), (2, "alpha beta gamma delta", "a"), (3, None, None), (4, "", "b"), (5, LONG, "b"), (6, "Ä alpha", "a"), (7, "ä alpha", None), (2, "alpha beta gamma delta", "a")]


def test_exact_dedup_groups_by_bytes(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.assign(docs_of(spark, ROWS)).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)}


@pytest.mark.parametrize("bits", [1, 3, 64])
def test_exact_dedup_chains_colliding_hashes_and_splits_buckets(spark, bits):
    rows = [(i, f"text {i % 40}", "s") for i in range(100)]
    index = exact_dedup.build_index(docs_of(spark, rows), bucket_rows=4, hash_bits=bits)
    assert index.entries.count() == 40 and index.entries.select("h", "chain").distinct().count() == 40
    assert (index.collided is None) == (bits == 64)
    if bits == 64:
        assert index.entries.groupBy("depth", "prefix").count().agg(F.max("count")).first()[0] <= 4
        assert index.entries.select("depth").distinct().count() > 1  # some split, others did not
    got = exact_dedup.assign(docs_of(spark, rows), 4, bits).where("kept").select("doc_id").collect()
    assert {r.doc_id for r in got} == set(range(60, 100))


def test_exact_dedup_reads_its_result_from_the_index(spark):
    """The index alone decides: with other decisions in its entries, the look-up gives those; rows it lacks are not found."""
    docs = docs_of(spark, ROWS)
    for bits in (1, 64):
        index = exact_dedup.build_index(docs, 2, bits)
        index.entries = index.entries.withColumn("keep_id", F.lit(-1))
        assert {r.keep_id for r in exact_dedup.look_up(docs, index).collect()} == {-1}
        index.directory = index.directory.where("false")
        assert exact_dedup.look_up(docs, index).count() == 0


def test_exact_dedup_of_null_ids(spark):
    rows = [(None, "a", None), (1, "A", None), (None, "b", None), (None, "B", None), (4, "b c", None), (4, "a", None)]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.assign(docs_of(spark, rows)).collect())
    assert got == sorted([("None", "4", 3, False), ("1", "4", 3, False), ("4", "4", 3, True), ("None", "None", 2, True), ("None", "None", 2, True), ("4", "4", 1, True)])
    assert sorted(str(r.text) for r in exact_dedup.deduplicate(docs_of(spark, rows)).collect()) == ["B", "a", "b", "b c"]


def test_exact_dedup_empty(spark):
    assert exact_dedup.assign(docs_of(spark, [])).count() == 0


def test_targets_stop_at_three_times_and_fill_the_total(spark):
    sizes = spark.createDataFrame([("b", 10), ("a", 1000), (None, 5), ("c", 500)], "source string, size long")
    got = {r.source: (r.src, r.target) for r in mixing.targets(sizes).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 0, "b": 1, "c": 2, None: 3}
    assert got["b"][1] == 30 and got[None][1] == 15 and sum(v[1] for v in got.values()) == pytest.approx(1515)
    assert got["c"][1] == pytest.approx(3 * got["a"][1])


def test_permutation_is_exact(spark):
    for n in (1, 2, 7, 100, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_mix_meets_targets_and_limits(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(300, LONG, "a"), (301, None, "a"), (7, "x y", "b")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs).collect()))
    per = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        per[r.source_size, r.target] = per.get((r.source_size, r.target), 0) + r.taken
    for (_, target), taken in per.items():
        assert abs(taken - target) <= max(2 * mixing.BLOCK, 0.02 * target)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs_of(spark, [(1, None, None)])).collect()] == [0]


def model_of_mix(rows, weights=(1, 2, 3)):
    """taken per row, in plain Python: targets, streams in hash order, slots through the source's permutation."""
    import math

    import xxhash

    def h(*values, seed=42):  # chained over the columns; 32-bit for literals, 64-bit for columns and long literals
        for v, width in values:
            if v is not None:
                seed = xxhash.xxh64_intdigest(v.to_bytes(width, "little", signed=True), seed & (2**64 - 1))
        return seed - 2**64 if seed >= 2**63 else seed

    def perm(x, n, *seed):
        for i in range(1, mixing.ROUNDS + 1):
            other = (h(*seed, (i, 4)) % n + n - x) % n
            x = other if h(*seed, (i, 4), (max(x, other), 8)) & 1 else x
        return x

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    full = set()
    while True:
        rest = sum(whole.values()) - sum(3 * whole[s] for s in full)
        level = rest / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if 3 * whole[s] <= weight[s] * level}
        if more == full:
            break
        full = more
    target = {s: 3 * whole[s] if s in full else weight[s] * level for s in sources}
    parts = max(1, math.isqrt(len(rows)))
    taken = [0] * len(rows)
    for k, s in enumerate(sources):
        if not whole[s]:
            continue
        own = [i for i, r in enumerate(rows) if r[2] == s]
        own.sort(key=lambda i: (h((rows[i][0], 8)) % parts, h((rows[i][0], 8), (mixing.SEED, 4)), rows[i][0], size[i]))
        words = [i for i in own for _ in range(size[i])]
        n = math.ceil(whole[s] / mixing.BLOCK)
        draws = math.floor(target[s] / whole[s] * n + 0.5)
        for i in range(draws):
            at = i % n
            block = perm(at, min(n, draws - i + at), (mixing.SEED, 4), (k, 8))
            for i in words[block * mixing.BLOCK : (block + 1) * mixing.BLOCK]:
                taken[i] += 1
    return size, [whole[r[2]] for r in rows], [target[r[2]] for r in rows], taken


def test_mix_equals_the_model_and_its_own_blocks(spark):
    rng = random.Random(5)
    rows = [(i, " ".join([f"d{i}"] * rng.randint(0, 300)), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(200)] + [(300, None, "a"), (301, " ", None), (302, "d302 " * 5000, "c")]
    docs = docs_of(spark, rows)
    size, whole, target, taken = model_of_mix(rows)
    for shard in (7, mixing.SHARD):
        got = {r.doc_id: r for r in mixing.mix(docs, shard=shard).collect()}
        assert [(got[i].size, got[i].source_size, got[i].taken) for i, _, _ in rows] == list(zip(size, whole, taken, strict=True))
        assert [got[i].target for i, _, _ in rows] == pytest.approx(target)
        mixed = mixing.blocks(docs, shard=shard).collect()
        held = {}
        for r in mixed:
            assert len(r.words) <= mixing.BLOCK and 0 <= r.slot
            for w in r.words:
                held[int(w[1:])] = held.get(int(w[1:]), 0) + 1
        assert held == {i: t for (i, _, _), t in zip(rows, taken, strict=True) if t}
        places = {}
        for r in mixed:
            places.setdefault(r.shard, []).append(r.slot)
        assert sorted(places) == list(range(len(places)))
        assert all(sorted(x) == list(range(len(x))) for x in places.values())
        assert [len(places[k]) for k in sorted(places)][:-1] == [shard] * (len(places) - 1)


def test_mix_with_ties_and_null_ids(spark):
    rows = [(None, "a b c", "s"), (None, "d e f", "s"), (4, "g h i", "s"), (4, "g h i", "s"), (4, "j k l", "s"), (5, "m " * 200, None)]
    docs = docs_of(spark, rows)
    got = sorted(map(str, mixing.mix(docs).collect()))
    assert len(got) == len(rows) and got == sorted(map(str, mixing.mix(docs).collect()))
    words = [w for r in mixing.blocks(docs).collect() if r.source == "s" and r.epoch == 0 for w in r.words]
    assert sorted(words) == sorted("a b c d e f g h i g h i j k l".split())


def test_take_gives_out_the_target_shares(spark):
    rng = random.Random(2)
    rows = [(i, " ".join([f"w{i}"] * rng.randint(1, 400)), rng.choice(["a"] * 8 + ["b", "c", None])) for i in range(600)] + [(5, "x y", "b"), (None, "u v w", "c"), (None, "u v w", "c")]
    docs = docs_of(spark, rows)
    target, out = {}, {}
    for r in mixing.targets(docs.select("source", F.size(F.split("text", " ")).cast("long").alias("size"))).collect():
        target[r.source] = r.target
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    for r in taken.collect():
        out[r.source] = out.get(r.source, 0) + len(r.text.split())
    for source, words in target.items():
        assert abs(out[source] - words) <= 400 + mixing.BLOCK
    assert sorted(map(str, taken.collect())) == sorted(map(str, mixing.take(docs).collect()))


def test_chat_round_trip_and_layouts(spark):
    texts = ["<|im_end|>", "<\\|x|>", "<\\\\|", "plain\n\n<", None, "", "a" * 100_000, "é🙂"]
    rows = [(i, t, r, x) for i in range(3) for t, (r, x) in enumerate(zip(["user", "assistant", "sys\\n\ntem", None] * 2, texts, strict=True))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.parse(chat.render(chat.canonical(chat.records(table), "record"))).collect():
        assert [(t.role, t.content) for t in r.read_turns] == [(a or "", b or "") for _, _, a, b in rows[:8]]
        assert r.loss_text == "".join(x or "" for _, _, role, x in rows[:8] if role == "assistant")
    layouts = [
        '{"prompt": "p", "response": "r"}', '{"instruction": "p", "output": "r"}', '{"question": "p", "answer": "r"}', '{"completion": "r", "prompt": "p"}',
        '{"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "r"}]}', '{"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "r"}]}',
    ]
    got = chat.canonical(spark.createDataFrame([(x,) for x in [*layouts, '{"other": 1}', "broken", None]], "j string"), "j").collect()
    for r in got[:-3]:
        assert [(t.role, t.content) for t in r.turns] == [("user", "p"), ("assistant", "r")], r
    assert all(r.turns is None for r in got[-3:])
    assert len({r.fingerprint for r in got[:6]}) == 6


def test_bpe_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    codec = bpe.codec(*bpe.vocabulary())
    other = tiktoken.Encoding("own", pat_str=bpe.vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(2)
    pieces = ["a", "b", "the", "ing", "é", "ß", "日本", " ", "\n", "1", "23", "ZZ", "🙂", "'s", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(500)] + ["a" * 3000, " " * 3000, ""]
    for text in texts:
        ids = codec.encode(text)
        assert ids == other.encode_ordinary(text) and codec.decode(ids) == text.encode()
    got = bpe.encode_column(docs_of(spark, ROWS), *bpe.vocabulary(), digests=True).collect()
    for r, (_, text, _) in zip(got, ROWS, strict=True):
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_appends_and_edits_reuse_the_table():
    codec = bpe.codec(*bpe.vocabulary())
    rng = random.Random(3)
    for _ in range(200):
        word = bytes(rng.choices(b"abcdefting", k=rng.randint(1, 30)))
        new = bytes(rng.choices(b"abcdefting", k=rng.randint(0, 10)))
        at = rng.randint(0, len(word))
        ids, table = codec.edit(word, codec.last_tokens(word), at, new)
        assert table == codec.last_tokens(word[:at] + new) and codec.decode(ids) == word[:at] + new


def test_warc_round_trip(spark, tmp_path):
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nX: y", None), (4, "u", ""), (5, "u", "é" * 200_000), (6, "u", trap), (7, "u", "same"), (8, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    path = new_path(spark, "warc-test")
    warc.write(pages, path, segment=20_000)
    got = {r.record_id: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        r, payload = got[f"<urn:page:{i}>"], (html or "").encode()
        assert r.complete and r.payload_bytes == len(payload) and r.payload_digest == warc.base32(hashlib.sha1(payload).digest())
        assert (r.record_type, r.refers_to) == {1: ("revisit", "<urn:page:7>"), 2: ("revisit", "<urn:page:7>"), 3: ("revisit", "<urn:page:4>")}.get(i, ("response", None))


def test_warc_keeps_pages_that_share_an_id_apart(spark):
    long, other = "a" * 90_000, "b" * 90_000
    rows = [(1, "u", long), (1, "u", long), (1, "v", other), (None, "u", "c" * 90_000), (None, "u", "d" * 90_000), (2, "u", "same"), (2, "u", "own"), (3, "u", "same"), (0, "u", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "warc-shared")
    warc.write(pages, path)
    read = warc.read(spark, path).collect()
    assert len({r.record_id for r in read}) == len(read) == len(rows) and all(r.complete for r in read)
    digest = lambda text: warc.base32(hashlib.sha1(text.encode()).digest())
    page = lambda x: x.strip("<>").split(":")[2]
    got = sorted((page(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, page(r.refers_to or "::")) for r in read)
    refers = {(2, "same"): "3", (0, other): "1"}
    assert got == sorted(("" if i is None else str(i), len(h), digest(h), "revisit" if (i, h) in refers else "response", refers.get((i, h), "")) for i, _, h in rows)
    for r in read:
        assert r.refers_to is None or [x.payload_digest for x in read if x.record_id.startswith(r.refers_to[:-1])][:1] == [r.payload_digest]


def test_warc_frames_by_length_alone(spark):
    """Payloads that look like records, longer than a segment, at every border; an empty table."""
    mark, gap = "WARC/1.1\r\n", "\r\n\r\n"
    fields = "WARC-Type: response\r\nContent-Length: 3\r\n"
    texts = [mark * 20_000, (gap + mark) * 9_000, (gap + mark + mark) * 5_000, gap * 30_000, (mark + fields + gap + "abc" + gap) * 2_000, "x" * 32_000 + gap + mark, mark, gap]
    pages = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)] + [(None, "u", mark * 9_000)], "page_id long, url string, html string")
    path = new_path(spark, "warc-lengths")
    for segment in (32 * 1024, 777):
        warc.write(pages, path + str(segment), segment=segment)
        got = sorted((r.record_id, r.payload_bytes, r.payload_digest, r.complete) for r in warc.read(spark, path + str(segment)).collect())
        digest = lambda t: warc.base32(hashlib.sha1(t.encode()).digest())
        assert got == sorted((f"<urn:page:{i}>", len(t), digest(t), True) for i, t in [*enumerate(texts), ("", mark * 9_000)])
    warc.write(pages.limit(0), path + "-none")
    assert warc.read(spark, path + "-none").count() == 0


def test_warc_reports_records_that_break_off():
    whole = b"".join(warc.page_records(1, "u", b"z" * 9_000, "D", None, False))
    for cut in (10, 100, len(whole) - 500, len(whole) - 1):
        (fields, block), = warc.whole_records([whole[:cut]])
        assert not warc.decoded(fields.get("warc-type"), "sha1:D", None, block)[2]


def test_warc_finds_records_behind_a_missed_separator():
    records = [r for i in range(3) for r in warc.page_records(i, "u", b"x" * i, "D", None, False)]
    fragments = [warc.SEPARATOR.encode().join(records) + warc.SEPARATOR.encode()]
    assert [f["warc-record-id"] for f, _ in warc.whole_records(fragments)] == [f"<urn:page:{i}>" for i in range(3)]


def test_warc_reports_a_missing_segment(spark):
    records = list(warc.page_records(1, "u", b"z" * 90_000, "D", None, False, 20_000))
    whole = list(warc.whole_records([r for r in [records[0], *[x[len(warc.MARK) :] for x in records[2:]]]]))
    assert [int(f["warc-segment-number"]) for f, _ in whole] == [1, *range(3, len(records) + 1)]
    path = new_path(spark, "warc-gap")
    spark.createDataFrame([(r.decode(),) for r in [records[0], *records[2:]]], "value string").coalesce(1).write.option("lineSep", warc.SEPARATOR).text(path)
    assert [r.complete for r in warc.read(spark, path).collect()] == [False]


def brute_classes(rows, words, share):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [2000, 7])
def test_near_dedup_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(2, 120))]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = f"W{rng.randint(0, 400)}"
            rows.append((len(rows), " ".join(own), "s"))
    rows += [(200, None, None), (201, "", "s"), (202, " \n", "s"), (203, "one", "s"), (204, "ONE", "s"), (205, "one two", "s"), (206, LONG, "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.classes(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows, 3, 85)


def test_near_dedup_of_a_large_cluster_equals_brute_force(spark, monkeypatch):
    """5,000 texts around one, many just above and just below the threshold, in small blocks."""
    for name, value in {"STAR_DOCS": 400, "BLOCK_DOCS": 300}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(90)], []
    for i in range(5000):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5, 8])):
            own[rng.randrange(90)] = f"x{rng.randint(0, 30)}"
        rows.append((i, " ".join(own), "s"))
    words = [t.split() for _, t, _ in rows]
    sets = [{tuple(w[k : k + 3]) for k in range(88)} for w in words]
    names = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(names)), np.float32)
    for i, own in enumerate(sets):
        has[i, [names[g] for g in own]] = 1
    size, root = has.sum(1), np.arange(len(sets))
    both = has @ has.T
    near = 100 * both >= 85 * (size[:, None] + size[None, :] - both)
    while True:  # least label among neighbours, until nothing moves
        least = np.array([root[near[i]].min() for i in range(len(sets))])
        if (least == root).all():
            break
        root = least
    assert 100 < len(set(root)) < 4000
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.classes(docs_of(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in range(5000)}


def test_near_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 4000), (4500, 5000), (7, 7)]
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1200)} | {4500: 4000, 5000: 4000}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_near_dedup_with_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(None, a, None), (5, a, None), (5, b, None), (9, b, None), (None, b + " c", None), (None, "own", None), (None, "own", None), (7, "", None), (7, "", None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.classes(docs_of(spark, rows)).collect())
    assert got == sorted([("None", 28, "5", False), ("5", 28, "5", True), ("5", 28, "5", True), ("9", 28, "5", False), ("None", 29, "None", True), ("None", 1, "None", True), ("None", 1, "None", True), ("7", 0, "7", True), ("7", 0, "7", True)])
    left = sorted((str(r.doc_id), r.text) for r in near_dedup.keep_one(docs_of(spark, rows)).collect())
    assert left == sorted([("5", a), ("5", b), ("None", b + " c"), ("None", "own"), ("None", "own"), ("7", ""), ("7", "")])


def test_near_dedup_empty(spark):
    assert near_dedup.classes(docs_of(spark, [])).count() == 0
    assert [tuple(r) for r in near_dedup.classes(docs_of(spark, [(5, None, None)])).collect()] == [(5, 0, 5, True)]


def test_factorisation_machine_matches_the_pairwise_sum():
    m = quality.Machine()
    m.w = np.random.default_rng(1).normal(size=quality.WIDTH)
    index, value = quality.features("Some words, some words!! here | there", {})
    pairs = sum(m.v[i] @ m.v[j] * x * y for a, (i, x) in enumerate(zip(index, value, strict=True)) for j, y in list(zip(index, value, strict=True))[a + 1 :])
    assert m.raw(index, value) == pytest.approx(m.w0 + m.w[index] @ value + pairs)


def test_classifiers_on_odd_rows(spark):
    rows = [(i, ("you idiot, go away. " if i % 2 else "a fine day it is. ") * 3, "s") for i in range(120)] + [(500, None, None), (501, "", None), (502, LONG, None)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(120)] + [(999, 1, 1), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for module, cut in ((quality, 0.5), (toxicity, 0.7)):
        got = module.score(docs, module.fit(docs, labels)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
        assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 120)
        none = labels.where("doc_id < 0")
        assert len({r.score for r in module.score(docs, module.fit(docs, none)).where("doc_id < 120").collect()}) <= 2
        assert module.score(docs_of(spark, []), module.fit(docs, none)).count() == 0


@pytest.mark.parametrize("name, module, label, cut, least", [("op3_quality", quality, "quality", 0.5, 0.97), ("op9_toxicity", toxicity, "toxic", 0.7, 0.95)])
def test_classifier_queries_on_held_out_rows(spark, name, module, label, cut, least):
    """The query's rows against the model read row by row in plain Python, and its decisions against held-out labels."""
    import os
    import zlib

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in module.query(spark, d).collect()}
    model = module.fit(docs, labels)
    texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, (text, n) in texts.items():
        held = zlib.crc32(str(i).encode()) % 3 == 1
        score = model.score(*quality.features(text, {}, n)) if module is quality else model.score(text)
        assert got[i].held_out == held and got[i].score == pytest.approx(score, abs=1e-4) and got[i].predicted == int(got[i].score >= cut)
    held = [(got[r.doc_id].predicted, r[label]) for r in labels.collect() if r[label] is not None and got[r.doc_id].held_out]
    assert len(held) > 50 and sum(p == y for p, y in held) >= least * len(held)


def test_quality_reads_its_metadata():
    base = quality.features("some words here", {}, 15)
    assert [list(quality.features("some words here", {}, n)[0]) == list(base[0]) for n in (-1, None, 3, 1500)] == [True, False, False, False]


def test_classifiers_score_rows_that_repeat_an_id(spark):
    rows = [(i, ("you idiot, go away. " if i % 2 else "a fine day it is. ") * 3, "s") for i in range(60)] + [(1, "a fine day it is. " * 3, None), (None, "you idiot, go away. " * 3, None)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] * 2, "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        docs = docs_of(spark, rows)
        got = sorted((str(r.doc_id), r.predicted) for r in module.score(docs, module.fit(docs, labels)).collect())
        assert len(got) == len(rows) and got[-1] == ("None", 1) and [p for i, p in got if i == "1"] == [0, 1]


def test_grammar_weighs_context():
    g = toxicity.Grammar({"idiot$": 4.0})
    weight = lambda t: sum(w for *_, w in g.clauses(t))
    assert weight("not an idiot") < weight("he said idiot") < weight("an idiot") < weight("you idiot")
    assert weight("i kill you") > weight("i kill time") == 0


def test_licences_need_ordered_sentences(spark):
    rows = [(1, "Text.\nReleased under the MIT License.", None), (2, "You may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp", None), (3, "You may obtain a copy of the License at\nYou may not use this file except in compliance with the License.", None), (4, None, None), (5, LONG, None)]
    got = {r.doc_id: r.licenses for r in licenses.recognise(docs_of(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "", 4: "", 5: ""}


APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


LGPL = GPL.replace("GNU General", "GNU Lesser General")
AGPL = GPL.replace("GNU General", "GNU Affero General")
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_licences_in_the_sql_twin(spark):
    """The twin on the notices, odd rows and sentences in every place; repeated rows and the empty table."""
    duckdb = pytest.importorskip("duckdb")
    texts = [APACHE, GPL.format(3), GPL.format(2), MIT, BSD, BSD + ENDORSE, LGPL.format("2.1"), LGPL.format(3), AGPL.format(3), MPL, ISC, APACHE + MIT, "a. " + MIT + BSD, None, "", " ", LONG, "Released under the" + " " * 600 + "MIT License.", "x \x01 y\x02 all rights reserved", "All rights reserved", "1. All rights reserved. 2 All rights reserved\n3) all rights reservedly", "All rights reserved all rights reserved not. All\n\nrights reserved", APACHE]
    docs = docs_of(spark, [(i, t, None) for i, t in enumerate(texts)] + [(3, MIT, None)])
    for rows in (docs, docs.limit(0)):
        frame = rows.select("doc_id", "text").toPandas()
        con = duckdb.connect()
        con.register("documents", frame)
        if not len(frame):
            con.execute("create or replace temp view documents as select 1::bigint as doc_id, ''::varchar as text where false")
        want = sorted(con.execute(licenses.SQL).fetchall())
        got = sorted(tuple(r) for r in licenses.recognise(rows).collect())
        assert got == want


def test_licences_of_real_notices(spark):
    texts = {
        "Apache-2.0": [APACHE, "Some | row |\nLicensed under the Apache License, Version 2.0."],
        "GPL-3.0": [GPL.format(3), "Text.\nThis work is licensed under the GNU General Public License, version 3."],
        "GPL-2.0": [GPL.format(2)],
        "MIT": [MIT],
        "BSD-2-Clause": [BSD],
        "BSD-2-Clause,BSD-3-Clause": [BSD + ENDORSE],
        "LGPL-2.1": [LGPL.format("2.1")],
        "LGPL-3.0": [LGPL.format(3)],
        "AGPL-3.0": [AGPL.format(3)],
        "MPL-2.0": [MPL],
        "ISC": [ISC],
        "MIT,MPL-2.0": [MPL + "\n" + MIT],
        "": ["It is not licensed under the Apache License, Version 2.0.", "Released under the MIT Licenses."],
    }
    rows = [(name, text) for name, some in texts.items() for text in some]
    got = {r.doc_id: r.licenses for r in licenses.recognise(docs_of(spark, [(i, text, None) for i, (_, text) in enumerate(rows)])).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, size=(600, 1))
    x[50:90] = x[40]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] + [0.0] * 14), (904, [1.0]), (905, [float("inf")] * 16)]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), shard=250, block=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort([np.arange(600), -s]) if i != q][:20]
        hits += len({i for i, _ in got[q]} & set(order))
        assert len(got[q]) == 20 and all(score == pytest.approx(s[i]) for i, score in got[q])
    assert hits >= 0.95 * 600
    none = neighbours.usable(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>"))
    assert neighbours.search(none, none).count() == 0


def test_neighbours_of_repeated_queries_and_extra_columns(spark):
    rng = np.random.default_rng(8)
    x = [[float(c) for c in v] for v in rng.normal(size=(120, 8))]
    rows = [(i, v) for i, v in enumerate(x)] + [(20, x[20]), (20, x[20]), (40, x[41]), (7, x[7])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("s", "b", "q", "v", "row", "rank", "score")})
    vectors = neighbours.usable(table)
    found = neighbours.search(vectors, vectors.where("vec_id in (20, 40, 60)"), shard=50, block=1).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert [len(got[q]) for q in (20, 40, 60)] == [20, 40, 20]
    for q, vector in ((20, x[20]), (60, x[60])):
        best = sorted(((float((np.array(v) * np.array(vector)).sum()), i) for i, v in rows if i != q), key=lambda p: (-p[0], p[1]))[:20]
        assert [(k, i) for k, i, _ in got[q]] == [(k, i) for k, (_, i) in enumerate(best, 1)]
        assert [c for *_, c in got[q]] == pytest.approx([c for c, _ in best])
