"""Language ID, chat formatting, TIFF, resharding, the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfold.llm import chat, language, queries, resharding, tiff

RANKS = P.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


# ---- resharding


def test_flow_is_cheapest():
    flow = resharding.min_cost_flow([10, 6, 2], [6, 6, 6])
    assert [sum(r) for r in flow] == [10, 6, 2] and [sum(c) for c in zip(*flow, strict=True)] == [6, 6, 6]
    assert sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == 4
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [4])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(1, 8))
def test_flow_moves_only_what_must(supply, new):
    total = sum(supply)
    capacity = [total // new + (j < total % new) for j in range(new)]
    flow = resharding.min_cost_flow(supply, capacity)
    stays = sum(flow[i][i] for i in range(min(len(supply), new)))
    assert stays == sum(min(a, b) for a, b in zip(supply, capacity, strict=False))
    assert [sum(c) for c in zip(*flow, strict=True)] == capacity


def test_reshard(spark, docs_of, tmp_path):
    random.seed(0)
    texts = [random.choice("abcdef") * random.randrange(400) for _ in range(600)] + ["hot text " * 40] * 250 + [None, "", "x" * 20_000]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, "no key")]
    plan = resharding.reshard(docs_of(rows), blocks=512)
    got = plan.collect()
    assert len(got) == len(rows)
    sizes, slots, where = {}, {}, {}
    for r in got:
        t = dict(rows)[r.doc_id] or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(t, set()).add(r.shard)
    assert set(sizes) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + 20_001
    assert all(len(s) == 1 for t, s in where.items() if t.count("hot") == 0)  # equal texts together
    assert resharding.reshard(docs_of([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=40, max_size=400), st.integers(1, 8), st.integers(1, 8))
def test_assignment_is_near_the_flow(sizes, old, new):
    """What the blocks move is the cheapest flow's cost, but for about a block a shard, and sizes are near equal."""
    blocks = [(k, k % old, b) for k, b in enumerate(sizes)]
    target = resharding.block_transfers(blocks, new)
    assert set(target) == {k for k, _, _ in blocks}
    held, supply = [0] * new, [0] * old
    for k, s, b in blocks:
        held[target[k]] += b
        supply[s] += b
    total = sum(sizes)
    capacity = [total // new + (j < total % new) for j in range(new)]
    cheapest = total - sum(min(a, b) for a, b in zip(supply, capacity, strict=False))
    moved = sum(b for k, s, b in blocks if target[k] != s)
    assert max(held) - min(held) <= max(sizes)
    assert moved <= cheapest + 2 * max(sizes) * max(old, new)


def test_old_shards_of_the_caller(spark, docs_of):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(300)]
    plan = resharding.reshard(docs_of(rows), old_shards=100, new_shards=4, old_shard=F.pmod("doc_id", F.lit(100)), blocks=400)
    got = plan.groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.max("slot").alias("last")).collect()
    assert sum(r.rows for r in got) == 300 and all(r.last == r.rows - 1 for r in got) and max(r.n for r in got) - min(r.n for r in got) < 100
    for bad in (F.lit(None).cast("int"), F.lit(100), F.lit(-1)):
        with pytest.raises(ValueError, match="old shards"):
            resharding.reshard(docs_of(rows), old_shards=100, old_shard=bad)


def test_a_hot_text_tears_no_other(spark, docs_of):
    rows = [(i, f"small {i % 60} " * 4) for i in range(600)] + [(1000 + i, "hot text " * 40) for i in range(400)]
    got = resharding.reshard(docs_of(rows), old_shards=1, new_shards=4, blocks=1).drop("row").collect()
    where, slots, sizes = {}, {}, {}
    for r in got:
        where.setdefault(dict(rows)[r.doc_id], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert len(got) == 1000 and len(where.pop("hot text " * 40)) > 1 and all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(sizes.values()) < 1.05 * sum(sizes.values()) / 4


def test_rewrite_touches_only_changed_shards(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"text {i} " * (i % 7)) for i in range(100)])
    plan = resharding.reshard(docs, old_shards=4, new_shards=5, blocks=64)
    changed = resharding.rewrite(docs, plan, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert 4 in changed and set(changed) == {r.shard for r in back.select("shard").distinct().collect()}
    assert back.count() == plan.where(F.col("shard").isin(changed)).count()
    still = plan.withColumn("shard", F.col("old_shard"))
    assert resharding.rewrite(docs, still, str(tmp_path / "none")) == []


def test_rewrite_keeps_whole_rows_and_deletes_emptied_shards(spark, docs_of, tmp_path):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(120)] + [(None, "no key"), (None, "no key"), (None, None), (5, "again"), (5, "again"), (5, "other")]
    path = str(tmp_path / "shards")
    docs_of(rows).withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(16)).cast("int")).write.partitionBy("shard").parquet(path)
    docs = spark.read.parquet(path)
    before = sorted(map(str, docs.drop("shard").collect()))
    changed = resharding.rewrite(docs, resharding.reshard(docs, old_shards=16, new_shards=12, old_shard=F.col("shard"), blocks=1024), path)
    back = spark.read.parquet(path)
    assert {12, 13, 14, 15} <= set(changed) and sorted(map(str, back.drop("shard", "slot").collect())) == before
    slots = {r.shard: sorted(r.slots) for r in back.groupBy("shard").agg(F.collect_list("slot").alias("slots")).collect()}
    assert max(slots) < 12 and all(slots[s] == list(range(len(slots[s]))) for s in changed if s < 12)


def test_resharding_query_writes_and_reads_back(spark):
    from tarnfold.llm.shared import work_folder

    out = queries.op5_resharding(spark, SF)
    assert out.inputFiles() and all(work_folder(spark) in f and "/shard=" in f for f in out.inputFiles())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = docs.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    assert sorted(map(tuple, out.select("doc_id", "size", "text_crc32").collect())) == sorted(map(tuple, want.collect()))
    plan = resharding.reshard(docs)
    assert sorted(map(tuple, out.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, plan.select("doc_id", "shard", "slot").collect()))


# ---- language


def test_language_held_out_accuracy(spark):
    out = queries.op4_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.min("score"), F.max("score"), F.count("*")).first()
    assert r[0] > 0.99 and 0 <= r[1] <= r[2] <= 1 and r[3] > 250


def test_language_edges(spark, docs_of):
    train = [(i, "the and of to in is that it was for on are") for i in range(6)] + [(i + 10, "der die und das nicht ist ein zu mit auf für") for i in range(6)]
    docs = docs_of(train).withColumn("lang", F.when(F.col("doc_id") < 10, "en").otherwise("de"))
    model = language.train(docs, "text", "lang")
    assert model.families == ["germanic"] and model.languages == [["de", "en"]]
    odd = docs_of([(1, None), (2, ""), (3, "123 !? …"), (4, "the is of"), (5, "das ist nicht"), (None, "und die"), (7, "漢字"), (7, "漢字"), (8, "the and " * 50_000), (9, "1" * 100 + "a")])
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (None, "de"), (8, "en")} <= got and (7, "und") not in got and (9, "und") not in got
    kept = language.identify(odd, model, keep=True)
    assert kept.columns == ["doc_id", "text", "lang", "source", "ids", "lang_pred", "score"]
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.train(docs.withColumn("lang", F.lit(None).cast("string")), "text", "lang") is None
    one = language.train(docs.where("lang = 'en'"), "text", "lang")
    assert {r.lang_pred for r in language.identify(docs, one).collect()} == {"en"}
    assert language.identify(odd.limit(0), model).count() == 0


def test_sample_depends_on_texts_only(spark):
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    one = language.train(clean.repartition(7), "text", "lang", sample=80)
    null = clean.withColumn("doc_id", F.lit(None).cast("long"))
    other = language.train(null.unionByName(null).repartition(3), "text", "lang", sample=80)
    assert one.families == other.families and (one.family_weights == other.family_weights).all() and one.least == other.least
    copies = clean.where("lang = 'en'").limit(1).crossJoin(spark.range(3000)).select("doc_id", "text", "lang").unionByName(clean.where("lang = 'de'").limit(1))
    few = language.train(copies, "text", "lang")  # a text a language, whatever its hash
    assert few.languages == [["de", "en"]]
    assert {(r.lang, r.lang_pred) for r in language.identify(copies, few, keep=True).select("lang", "lang_pred").distinct().collect()} == {("en", "en"), ("de", "de")}


def plain_svm(x, y, ridge, epochs=300):
    """The dual of the squared hinge by plain coordinate descent in double precision, a bias as one more feature."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    alpha = np.zeros(len(y))
    kernel = (y[:, None] * x) @ (y[:, None] * x).T + np.diag(ridge)
    for _ in range(epochs):
        for i in range(len(y)):
            alpha[i] = max(0.0, alpha[i] - (kernel[i] @ alpha - 1) / kernel[i, i])
    return (alpha * y) @ x


def test_machines_agree_with_brute_force():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 6)).astype(np.float32)
    labels = [["en", "de", "fr", "es"][k % 4] for k in range(40)]
    for i, c in enumerate(labels):
        x[i, "en de fr es".split().index(c)] += 1.5
    y = np.where(np.array(labels) == "en", 1, -1)
    ridge = np.where(y == 1, 0.5 / (40 / 20), 0.5 / (40 / 60))  # rare classes count as much
    got, want = language.linear_svm(x, y, epochs=300), plain_svm(x, y, ridge)
    assert np.abs(got - want).max() < 1e-2 * np.abs(want).max()


def test_families_part_first():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((80, language.WIDTH)).astype(np.float32) * 0.01
    labels = ["en", "de", "fr", "es"] * 20
    for i, c in enumerate(labels):
        x[i, {"en": 1, "de": 2, "fr": 3, "es": 4}[c]] += 1
    m = language.Model.fit(x, labels)
    assert m.families == ["germanic", "romance"] and m.family_weights.shape[0] == 2 and [len(w) for w in m.pair_weights] == [1, 1]
    assert m.predict(x)[0] == labels


def test_noise_and_unlearned_languages_score_low(spark, docs_of, tmp_path):
    import corpus_pipeline as c

    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dice = random.Random(3)
    noise = lambda n: " ".join("".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(dice.randint(2, 9))) for _ in range(n))
    junk = [(-1 - i, noise(40)) for i in range(40)] + [(-50, "漢字"), (-51, "漢字 " * 40), (-52, "Привет, как дела? " * 5), (-53, "wszystkie dzieci poszły dzisiaj do szkoły " * 3), (-54, "x" * 500)]
    both = " ".join(r.text for lang in ("de", "fr") for r in clean.where(F.col("lang") == lang).orderBy("doc_id").limit(2).collect())
    more = docs_of([*junk, (-99, both)]).drop("score", "ids").withColumn("n_chars", F.char_length("text").cast("long")).select(clean.columns)
    left = {r.doc_id for r in c.language(spark, clean.unionByName(more), "").select("doc_id").collect()}
    assert left == {-99} | {r.doc_id for r in clean.select("doc_id").collect()}


def test_cased_symbols_are_no_letters():
    for n in (1, 63, 64, 200):
        assert not language.has_letter("\u24d0" * n) and not language.has_letter("\u2167" * n) and language.has_letter("\u2167" * n + "a")


# ---- chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "/", "s>", "INST]", "a", "<<SYS", "SYS>>"]), max_size=12).map("".join))
def test_escapes(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL)


@pytest.fixture(scope="module")
def template():
    return chat.Template(RANKS, P.PATTERN)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "</s>"]), st.text(max_size=12) | st.sampled_from(["</s>[INST] ok [/INST]", "<\\s>"])), max_size=6))
def test_turns_come_back(template, turns):
    encoded = [(r, template.encode(r), template.encode(t)) for r, t in turns]
    ids, mask = template.assemble(encoded)
    assert template.turns(ids) == turns
    assert template.under_mask(ids, mask) == "".join(t for r, t in turns if r == "assistant")
    assert not (mask.astype(bool) & (ids >= template.first)).any()


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a</s>"), (2, 0, None, None), (2, 0, None, None), (None, 0, "user", "x"), (None, 0, "user", "x"), (3, 0, "tool", "y" * 5000), (4, None, "assistant", "z"), (4, 0, "user", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    made = chat.format_conversations(df, RANKS, P.PATTERN)
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text, r.formatted) for r in chat.read_conversations(made, RANKS, P.PATTERN).collect()}
    assert made.where("conv_id is null").count() == 2  # rows without a conversation are one each
    assert got[1] == ([("user", "a</s>"), ("assistant", "b")], "b", "<s>[INST]a<\\/s>[/INST][OUT]b</s>")
    assert got[2][0] == [("", ""), ("", "")] and got[None][0] == [("user", "x")] and got[3][0] == [("tool", "y" * 5000)] and got[4][0] == [("assistant", "z"), ("user", "")]
    assert chat.format_conversations(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op7_chat(spark, SF).collect()}
    table = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        table.setdefault(r.conv_id, []).append((r.role, r.text))
    table[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == table.keys()
    for k, turns in table.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k].loss_chars == len(loss) and got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# ---- TIFF


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
def test_tiff_round_trips(compression):
    rng = np.random.default_rng(0)
    for size in ((1, 1, 1), (70, 33, 1), (40, 64, 3), (130, 257, 1)):
        for kind in (np.uint8, np.uint16):
            images = [rng.integers(0, 5, size).astype(kind), rng.integers(0, 250, size).astype(kind), np.zeros(size, kind)]
            for predictor in (1, 2):
                for tile in (None, (32, 48)):
                    for order in "<>":
                        pages = list(tiff.read_pages(tiff.write_pages(images, compression, predictor, tile=tile, order=order)))
                        assert [p.number for p in pages] == [0, 1, 2] and all((p.pixels == x).all() for p, x in zip(pages, images, strict=True))


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600) | st.lists(st.sampled_from([b"a" * 90, b"ab", b"xyz"]), max_size=60).map(b"".join))
def test_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data) + 1) == data


def test_lzw_past_the_table_limit():
    data = np.random.default_rng(1).integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data) + 1) == data


def test_known_lzw_stream():
    # CLEAR, 'A', 'A', END in nine-bit codes
    bits = "".join(f"{c:09b}" for c in (256, 65, 65, 257)).ljust(40, "0")
    assert tiff.lzw_decode(int(bits, 2).to_bytes(5, "big"), 9) == b"AA"


def test_planes_and_damage():
    import struct

    planes = [bytes([1, 2, 3, 4]), bytes([5, 6, 7, 8])]
    tags = [(256, 3, [2]), (257, 3, [2]), (258, 3, [8, 8]), (259, 3, [1]), (273, 4, [8, 12]), (277, 3, [2]), (278, 3, [2]), (279, 4, [4, 4]), (284, 3, [2])]
    body, extra, at = b"", b"", 16 + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            extra, raw, at = extra + raw, struct.pack("<I", at), at + len(raw)
        body += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    data = struct.pack("<2sHI", b"II", 42, 16) + planes[0] + planes[1] + struct.pack("<H", len(tags)) + body + b"\0" * 4 + extra
    (page,) = tiff.read_pages(data)
    assert page.pixels.tolist() == [[[1, 5], [2, 6]], [[3, 7], [4, 8]]]
    loop = bytearray(data)
    struct.pack_into("<I", loop, 16 + 2 + 12 * len(tags), 16)
    for bad in (b"", b"nope", bytes(loop), data[:30]):
        with pytest.raises((ValueError, struct.error, IndexError, KeyError)):
            list(tiff.read_pages(bad))


def by_hand(tags, data, order="<"):
    """A one-page file from (tag, type, values), its segment at byte 8."""
    import struct

    at = 8 + len(data)
    body, extra = b"", b""
    behind = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in sorted(tags):
        raw = struct.pack(f"{order}{len(values)}{tiff.TYPES[kind]}", *values)
        if len(raw) > 4:
            raw, extra, behind = struct.pack(order + "I", behind), extra + raw, behind + len(raw)
        body += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + data + struct.pack(order + "H", len(tags)) + body + b"\0" * 4 + extra


def page_tags(width, height, bits, size, samples=1, **more):
    base = {256: (4, [width]), 257: (4, [height]), 258: (3, [bits] * samples), 259: (3, [1]), 273: (4, [8]), 277: (3, [samples]), 278: (4, [height]), 279: (4, [size])}
    base |= {int(k[1:]): v for k, v in more.items()}
    return [(t, *v) for t, v in base.items() if v]


def test_small_samples_by_hand():
    bilevel = bytes([0b10110000, 0b01000000, 0b11111111, 0b10000000])  # two rows of 9 pixels
    (page,) = tiff.read_pages(by_hand(page_tags(9, 2, 1, 4), bilevel))
    assert page.pixels[:, :, 0].tolist() == [[1, 0, 1, 1, 0, 0, 0, 0, 0], [1] * 9] and page.bits == 1
    (page,) = tiff.read_pages(by_hand(page_tags(9, 2, 1, 4, t266=(3, [2])), bytes(int(f"{b:08b}"[::-1], 2) for b in bilevel)))
    assert page.pixels[:, :, 0].tolist() == [[1, 0, 1, 1, 0, 0, 0, 0, 0], [1] * 9]
    default = [t for t in page_tags(8, 1, 1, 1) if t[0] not in (258, 277, 278)]  # bilevel is the default
    assert next(tiff.read_pages(by_hand(default, b"\xa5"))).pixels.ravel().tolist() == [1, 0, 1, 0, 0, 1, 0, 1]
    (page,) = tiff.read_pages(by_hand(page_tags(3, 2, 4, 4), bytes([0x12, 0x30, 0xAB, 0xC0])))
    assert page.pixels[:, :, 0].tolist() == [[1, 2, 3], [10, 11, 12]]
    (page,) = tiff.read_pages(by_hand(page_tags(2, 1, 16, 4, t339=(3, [2]), t317=(3, [2])), b"\xff\xff\xfe\xff"))
    assert page.pixels.ravel().tolist() == [-1, -3]
    # one row 1.0, 2.0 as big-endian bytes 3f80 0000 4000 0000: by significance 3f 40 80 00 00 00 00 00, as differences
    (page,) = tiff.read_pages(by_hand(page_tags(2, 1, 32, 8, t339=(3, [3]), t317=(3, [3])), bytes([0x3F, 0x01, 0x40, 0x80, 0, 0, 0, 0])))
    assert page.pixels.ravel().tolist() == [1.0, 2.0] and "mean=1.5000" in tiff.features(page.pixels)


def test_wide_and_floating_samples_round_trip():
    rng = np.random.default_rng(3)
    for kind in (np.uint32, np.int16, np.int32, np.float16, np.float32, np.float64):
        image = (rng.standard_normal((37, 50, 2)) * 1000).astype(kind)
        for predictor in (1, 3) if image.dtype.kind == "f" else (1, 2):
            for tile in (None, (16, 32)):
                for order in "<>":
                    (page,) = tiff.read_pages(tiff.write_pages([image], tiff.LZW, predictor, tile=tile, order=order))
                    assert (page.pixels == image).all() and page.bits == 8 * image.dtype.itemsize


def test_damage_costs_a_row_and_no_job(spark):
    good = tiff.write_pages([np.ones((2, 2, 1), np.uint8), np.ones((9, 4, 1), np.uint8)])
    bad = {
        "rows per strip 0": by_hand(page_tags(2, 2, 8, 4, t278=(4, [0])), b"abcd"),
        "height 0": by_hand(page_tags(2, 0, 8, 4), b"abcd"),
        "width a float": by_hand(page_tags(2, 2, 8, 4, t256=(11, [2.0])), b"abcd"),
        "no samples": by_hand(page_tags(2, 2, 8, 4, t277=(3, [0])), b"abcd"),
        "tile width 0": by_hand(page_tags(2, 2, 8, 4, t322=(4, [0]), t323=(4, [2]), t324=(4, [8]), t325=(4, [4])), b"abcd"),
        "no offsets": by_hand(page_tags(2, 2, 8, 4, t273=None), b"abcd"),
        "huge": by_hand(page_tags(1 << 31, 1 << 31, 8, 4), b"abcd"),
        "bits differ": by_hand(page_tags(2, 2, 8, 4, samples=2, t258=(3, [8, 16])), b"abcd"),
        "short": by_hand(page_tags(2, 3, 8, 4), b"abcd"),
        "not deflate": by_hand(page_tags(2, 2, 8, 4, t259=(3, [8])), b"abcd"),
        "lzw without a table": by_hand(page_tags(2, 2, 8, 4, t259=(3, [5])), bytes([0x82, 0x00, 0x00, 0x00])),
        "unknown compression": by_hand(page_tags(2, 2, 8, 4, t259=(3, [7])), b"abcd"),
        "no page": b"II*\0\0\0\0\0",
        "cut": good[: len(good) // 2],
    }
    rng = random.Random(8)
    for k in range(60):  # and any bytes changed
        worse = bytearray(good)
        for _ in range(4):
            worse[rng.randrange(len(worse))] = rng.randrange(256)
        bad[f"random {k}"] = bytes(worse)
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in bad.items()] + [("good", bytearray(good))], "name string, media binary")
    got = {}
    for r in tiff.read_media(df).select("name", "page", "error").collect():
        got.setdefault(r.name, []).append((r.page, r.error))
    assert set(got) == {*bad, "good"} and [p for p, _ in got["good"]] == [0, 1]
    assert all(got[k][-1][0] is None and got[k][-1][1] for k in bad if not k.startswith("random"))


def test_bombs_stop_at_the_declared_size():
    zeros = bytes(1 << 20)
    assert len(tiff.lzw_decode(tiff.lzw_encode(zeros), 100)) < 2000
    assert len(tiff.unpack_bits(tiff.pack_bits(zeros), 100)) <= 228 and len(tiff._inflate(zlib.compress(zeros), 100)) == 100
    with pytest.raises(ValueError, match="more than 1000 bytes"):
        list(tiff.read_pages(tiff.write_pages([np.zeros((40, 40, 1), np.uint8)]), 1000))


def test_media_rows(spark, docs_of):
    rows = [(1, "a" * 100), (2, None), (3, ""), (4, "é" * 64), (4, "é" * 64), (None, "x"), (6, "long " * 40_000)]
    stored = tiff.store_texts(docs_of(rows))
    got = tiff.digests(tiff.read_media(stored)).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert len({r.media_sha256 for r in got if r.doc_id == 4}) == 1
    two = tiff.write_pages([np.ones((2, 2, 1), np.uint8), np.zeros((3, 1, 1), np.uint16)])
    odd = spark.createDataFrame([(1, bytearray(two), "w"), (2, bytearray(b"bad"), "w"), (3, None, "w")], "doc_id long, media binary, width string")
    pages = tiff.read_media(odd).orderBy("doc_id", "page").collect()
    assert [(p.doc_id, p.page, p.width, p.height, p.bits) for p in pages] == [(1, 0, 2, 2, 8), (1, 1, 1, 3, 16), (2, None, None, None, None), (3, None, None, None, None)]
    assert pages[2].error == "not a TIFF file" and tiff.read_media(odd.limit(0)).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, docs_of, tmp_path):
    import corpus_pipeline as c

    random.seed(2)
    say = lambda n: " ".join(random.choice("the and of to in house tree river stone cloud walk green seven".split()) + str(random.randrange(90)) for _ in range(n))
    passage = say(70)
    same = say(60)
    texts = {1: say(80), 2: None, 3: "12345 !!!", 4: same, 5: same, 6: same + " more", 7: say(30) + " " + passage + " " + say(30), 8: say(20) + " " + passage, 9: passage + " é" + say(5)}
    docs = docs_of([*texts.items(), (1, texts[1]), (None, say(50))]).drop("score", "ids").withColumn("n_chars", F.char_length("text").cast("long"))
    kept = {}
    for k, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if k < len(c.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: sorted((r.doc_id or -1) for r in rows) for n, rows in kept.items()}
    assert ids["language"] == [-1, 1, 1, 4, 5, 6, 7, 8, 9]
    assert ids["near_duplicate"] == [-1, 1, 4, 7, 8, 9]
    left = {r.doc_id: r.text for r in kept["repeats"]}
    assert left[1] == texts[1] and all(passage[20:-20] not in left[d] for d in (7, 8, 9)) and all(r.n_chars == len(r.text) for r in kept["repeats"])
    assert {r.doc_id for r in kept["packing"]} == set(left)
    empty = docs_of([]).drop("score", "ids").withColumn("n_chars", F.lit(1).cast("long"))
    for _, stage in c.STAGES:
        assert stage(spark, empty, "").count() == 0
    # clashing names, a stage on another's unwritten result, no labels, null keys
    odd = docs_of([(None, say(70)), (None, say(70)), (1, say(70)), (1, say(70)), (2, None)]).withColumns({c: F.lit(c) for c in ("lang_pred", "h1", "t", "runs", "row", "kept_text", "n_removed", "component_id", "k")})
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert c.language(spark, unlabelled, "").count() == 5
    chained = c.repeats(spark, c.near_duplicate(spark, c.language(spark, odd, ""), ""), "")
    assert chained.columns == odd.columns and chained.count() == 4
    for r in chained.collect():
        assert (r.lang_pred, r.h1, r.t, r.row, r.kept_text, r.k, r.score) == ("lang_pred", "h1", "t", "row", "kept_text", "k", 1.5)
    assert c.packing(spark, chained, "").count() >= 4
    assert c.run(spark, SF).count() > 0


def test_tiff_of_a_very_long_text(spark):
    """Texts above what a page of unknown size may have: rows name their own bound; 300 MiB through writer and reader."""
    docs = spark.createDataFrame([(1, "x" * 5000), (2, ""), (3, "y" * 64)], "doc_id long, text string")
    stored = tiff.store_texts(docs)
    assert {r.doc_id: r.error is None for r in tiff.read_media(stored, largest=4999).collect()} == {1: False, 2: True, 3: True}
    assert all(r.error is None for r in tiff.read_media(stored, largest=F.col("n_bytes") + 64).collect())
    data = np.tile(np.frombuffer(b"0123456789abcde\n", np.uint8), 300 << 16)
    blob = tiff.write_pages([data.reshape(-1, 64, 1)])
    (page,) = tiff.read_pages(blob, data.size + 64)
    assert (page.pixels.reshape(-1) == data).all()
    assert tiff.features(page.pixels).startswith(f"64x{300 << 14} min=10 max=101")
    with pytest.raises(ValueError):
        list(tiff.read_pages(blob))
