"""Resharding by minimum-cost flow.

Documents live in old shards, cut into blocks by a hash of their text (equal texts share a block). From
the old shard sizes and the new capacities a transport problem is solved whose cost is the bytes that
change shard; blocks are then picked to realise the flow, and only shards that gain or lose a block are
rewritten (``rewrite``), from rows that the plan carries whole.

Scale: the driver sees block totals only (at most ``blocks`` + the pieces of split blocks, a constant: with old
shards of the caller's, each is cut into its part of ``blocks``, and there may be as many as that);
documents are dealt by block, never by shard, so a shard of any size is numbered by many tasks. A block
above ``1 / split`` of a shard's capacity is cut by a hash of the text for the numbering, and a text that
is itself above that (a hot group of equal texts; at most ``new_shards * split`` of them) by a hash of its
key. The law of near equal sizes comes first: above ``1 / together`` of a shard the pieces of a block, or of a
text, may also part.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def min_cost_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """Bytes to send from each old shard to each new one: cost 0 to stay, 1 a byte to move.

    Successive shortest augmenting paths with potentials on the bipartite graph old -> new. The sums
    of ``supply`` and ``capacity`` must agree or the capacity be larger.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("capacities below the supply")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    cost = [[0 if i == j else 1 for j in range(m)] for i in range(n)]
    potential = [0] * (n + m)
    while any(left):
        dist = [float("inf")] * (n + m)
        before: list[int | None] = [None] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < n:
                edges = ((n + j, cost[u][j]) for j in range(m))
            else:
                edges = ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in edges:
                e = d + c + potential[u] - potential[v]
                if e < dist[v]:
                    dist[v], before[v] = e, u
                    heapq.heappush(heap, (e, v))
        ends = [j for j in range(m) if room[j] and dist[n + j] < float("inf")]
        end = min(ends, key=lambda j: (dist[n + j] + potential[n + j], j))
        far = dist[n + end]
        for v in range(n + m):
            potential[v] += min(dist[v], far)
        path, v = [], n + end
        while v is not None:
            path.append(v)
            v = before[v]
        path.reverse()
        amount = min(left[path[0]], room[end])
        for u, v in zip(path, path[1:], strict=False):
            if u >= n:
                amount = min(amount, flow[v][u - n])
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[path[0]] -= amount
        room[end] -= amount
    return flow


def block_transfers(blocks: list[tuple], new_shards: int) -> dict:
    """New shard of each block. ``blocks``: (key, old shard, bytes).

    The flow says how many bytes leave each old shard for each new one; the blocks of an old shard go
    out largest first, each to the most open demand it fits. What no whole block fits is then levelled
    by moving or swapping single blocks between the fullest and the emptiest shard while that helps.
    """
    old = max((s for _, s, _ in blocks), default=-1) + 1
    total = sum(b for _, _, b in blocks)
    supply = [0] * old
    for _, s, b in blocks:
        supply[s] += b
    capacity = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    flow = min_cost_flow(supply, capacity)
    target, held = {}, [0] * new_shards
    members: list[list] = [[] for _ in range(new_shards)]
    for s in range(old):
        demand = {j: flow[s][j] for j in range(new_shards) if j != s and flow[s][j]}
        stay = flow[s][s] if s < new_shards else 0
        own = sorted((x for x in blocks if x[1] == s), key=lambda x: (-x[2], x[0]))
        for key, _, b in own:
            fits = [j for j in demand if demand[j] >= b]
            if stay >= b and s < new_shards and stay >= max(demand.values(), default=0):
                j = s
                stay -= b
            elif fits:
                j = max(fits, key=lambda x: (demand[x], -x))
                demand[j] -= b
            elif s < new_shards and stay >= b:
                j = s
                stay -= b
            else:
                j = min(range(new_shards), key=lambda x: (held[x] + b - capacity[x], x))
            target[key] = j
            held[j] += b
            members[j].append((b, key))
    return _level(members, held, target)


def _level(members: list[list], held: list[int], target: dict) -> dict:
    for m in members:
        m.sort()
    for _ in range(64 * len(held)):
        hi = max(range(len(held)), key=held.__getitem__)
        lo = min(range(len(held)), key=held.__getitem__)
        gap = held[hi] - held[lo]
        if gap <= 1 or not members[hi]:
            break
        want = gap / 2
        best = min(members[hi], key=lambda x: (abs(x[0] - want), x[1]))
        give, take = best, None
        gain = abs(want - best[0])
        if gain > 0 and members[lo]:  # swap of two blocks whose difference is nearer to half the gap
            small, k = members[lo], 0
            for x in members[hi]:
                while k + 1 < len(small) and small[k + 1][0] <= x[0] - want:
                    k += 1
                for y in small[k : k + 2]:
                    if abs(x[0] - y[0] - want) < gain:
                        give, take, gain = x, y, abs(x[0] - y[0] - want)
        moved = give[0] - (take[0] if take else 0)
        if not 0 < moved < gap:
            break
        members[hi].remove(give)
        members[lo].append(give)
        target[give[1]] = lo
        if take:
            members[lo].remove(take)
            members[hi].append(take)
            target[take[1]] = hi
        held[hi] -= moved
        held[lo] += moved
        members[hi].sort()
        members[lo].sort()
    return target


def reshard(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    old_shards: int = 12,
    new_shards: int = 16,
    old_shard: Column | None = None,
    blocks: int = 16384,
    split: int = 128,
    together: int = 4,
) -> DataFrame:
    """Assign every row of ``docs`` a new shard of near equal bytes, moving the fewest bytes.

    Returns ``key, size, text_crc32, old_shard, shard, slot`` and ``row``, the whole row of ``docs`` for
    ``rewrite``; other columns are not needed and may have any name. Rows come in ranges of shard and slot.
    ``docs`` is read more than once and must give the same rows each time. ``old_shard`` gives the present shard, 0 to
    ``old_shards`` - 1 (default: block modulo ``old_shards``; null or another number is an error).
    Size is the UTF-8 length plus 1 (null: 1). Null keys are a value like any other; repeated rows are
    kept and get slots of their own. An empty table gives no rows. Equal texts of an old
    shard stay together unless they are more than ``1 / together`` of a new one; numbering is spread finer.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    block = F.pmod(F.xxhash64(raw), F.lit(blocks if old_shard is None else max(1, blocks // max(1, old_shards))))
    rows = docs.select(
        F.col(key).cast("long").alias("k"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        block.cast("int").alias("block"),
        (F.pmod(block, F.lit(old_shards)) if old_shard is None else old_shard).cast("int").alias("old_shard"),
        F.pmod(F.xxhash64(F.lit("piece"), F.col(key).cast("long")), F.lit(1 << 20)).cast("int").alias("h"),
        F.xxhash64(F.lit("text"), raw).alias("th"),
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
    )
    spark = docs.sparkSession
    by_block = rows.groupBy("block", "old_shard").agg(F.sum("size").alias("bytes")).collect()
    if any(r.old_shard is None or not 0 <= r.old_shard < old_shards for r in by_block):
        raise ValueError(f"old shards must be 0 to {old_shards - 1}")
    total = sum(r.bytes for r in by_block)
    most = max(1, total // (new_shards * split))
    large = {(r.block, r.old_shard): r.bytes for r in by_block if r.bytes > most}  # at most new_shards * split
    hot = []
    if large:
        of_large = rows.where(F.col("block").isin(sorted({b for b, _ in large})))
        hot = of_large.groupBy("block", "old_shard", "th").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most).collect()
    # pieces of a block: 0 .. n - 1 by text, then those of each hot text by key
    rest, first, unit_of = dict(large), {k: 0 for k in large}, {}
    for r in hot:
        rest[r.block, r.old_shard] -= r.bytes
    cuts = {k: max(1, min(1 << 12, -(-n // most))) for k, n in rest.items()}
    apart = {k for k, n in large.items() if n * together > total // new_shards}
    texts = []
    for r in sorted(hot, key=lambda r: (r.block, r.old_shard, r.th)):
        k, n = (r.block, r.old_shard), min(1 << 12, -(-r.bytes // most))
        at = cuts[k] + first[k]
        first[k] += n
        texts.append((*k, r.th, at, n))
        if r.bytes * together <= total // new_shards:
            unit_of.update({(*k, at + i): (*k, at) for i in range(n)})
    piece = F.lit(0)
    if large:
        made = F.create_map(*[F.lit(x) for (b, s), n in cuts.items() for x in (b * 65536 + s, n)])
        cut = F.coalesce(made[F.col("block") * 65536 + F.col("old_shard")], F.lit(1))
        piece = F.pmod("th", cut).cast("int")
    if texts:
        own = spark.createDataFrame(texts, "block int, old_shard int, th long, at int, many int")
        rows = rows.join(F.broadcast(own), ["block", "old_shard", "th"], "left")
        piece = F.coalesce(F.col("at") + F.pmod("h", F.col("many")), piece)
    rows = rows.withColumn("piece", piece)
    sizes = rows.groupBy("block", "old_shard", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    stats = sorted(((r.block, r.old_shard, r.piece), r.old_shard, r.bytes, r.n) for r in sizes)
    unit = {k: unit_of.get(k, k) if k[:2] in apart else k[:2] for k, _, _, _ in stats}
    weight: dict = {}
    for k, s, b, _ in stats:
        weight[unit[k], s] = weight.get((unit[k], s), 0) + b
    target = block_transfers([(u, s, b) for (u, s), b in sorted(weight.items())], new_shards)
    base, placed = [0] * new_shards, []
    for k, _, _, n in stats:
        shard = target[unit[k]]
        placed.append((*k, shard, base[shard]))
        base[shard] += n
    plan = spark.createDataFrame(placed, "block int, old_shard int, piece int, shard int, first long")
    # one exchange of whole rows, by range, so that the window and the writer need no other
    placed_rows = rows.join(F.broadcast(plan), ["block", "old_shard", "piece"]).repartitionByRange("shard", "first")
    order = Window.partitionBy("shard", "first").orderBy("k", "size", "text_crc32")
    return placed_rows.withColumn("rank", F.row_number().over(order) - 1).select(
        F.col("k").alias(key), "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("rank")).alias("slot"), "row"
    )


def rewrite(docs: DataFrame, plan: DataFrame, path: str, key: str = "doc_id") -> list[int]:
    """Write the shards of ``plan`` that changed as ``path/shard=<n>``; returns the numbers changed.

    A shard is unchanged if nothing leaves or enters it; a changed one that no row is left in is deleted.
    Rows are those that the plan carries, whole, so null and repeated keys are rows like any other; they
    are in the order of their slots, and columns of the names shard and slot are replaced. ``plan`` comes
    in ranges of slots, so that a large shard is several files. A null text stays null and an empty table
    changes nothing.
    """
    moves = plan.groupBy("old_shard", "shard").count().collect()
    changed = sorted({s for r in moves if r.shard != r.old_shard for s in (r.shard, r.old_shard)})
    if not changed:
        return []
    spark = docs.sparkSession
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    out = plan.where(F.col("shard").isin(changed)).select(*own, "shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for n in set(changed) - {r.shard for r in moves}:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={n}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return changed


def rewritten(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", new_shards: int = 16) -> DataFrame:
    """``key, size, text_crc32, shard, slot`` of every row after ``reshard`` and ``rewrite``.

    Rows of the shards that changed are read back from the files; others have their place in the plan.
    """
    plan = reshard(docs, key, text, new_shards=new_shards)
    changed = rewrite(docs, plan, path, key)
    still = plan.where(~F.col("shard").isin(changed)).select(key, "size", "text_crc32", "shard", "slot")
    if not changed:
        return still
    spark = docs.sparkSession
    kinds = {f.name: f for f in docs.schema.fields}
    back = spark.read.schema(StructType([kinds[key], kinds[text], StructField("slot", LongType()), StructField("shard", IntegerType())])).parquet(path)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    back = back.select(F.col(key).cast("long").alias(key), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), "shard", "slot")
    return back if set(range(new_shards)) <= set(changed) else back.unionByName(still)
