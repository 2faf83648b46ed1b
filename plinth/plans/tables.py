"""Chunk tables and the run ledger, over lineitem, orders, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import catalog as C
from plinth.operators import ledger as L
from plinth.operators import versioned as V
from plinth.plans.base import Plans, literal, literal_sql, table

plans = Plans()
QUERIES, SQL = plans.queries, plans.sql


def chunks(spark, sf_dir):
    """Order lines as chunks of a document: some without an ordinal."""
    n = F.col("l_linenumber").cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_orderkey") % 11 != 0, n - 1).alias("ordinal"), F.concat_ws("#c", F.col("l_orderkey").cast("string"), n.cast("string"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("path"))


CHUNKS = "(select l_orderkey as doc, case when l_orderkey % 11 <> 0 then l_linenumber - 1 end as ordinal, l_orderkey || '#c' || l_linenumber || '#c' || l_partkey as id, l_quantity as weight, l_returnflag as path from lineitem)"


@plans.add("d03_chunk_counts", f"select doc, max(coalesce(ordinal + 1, 1)) as chunks from {CHUNKS} group by doc")
def chunk_counts(spark, sf_dir):
    return C.chunk_counts(chunks(spark, sf_dir))


@plans.add("d04_d05_ordinals", f"select doc, coalesce(list_sort(list(distinct ordinal) filter (where ordinal is not null)), []) as ordinals, bool_or(ordinal is null) as unnumbered from {CHUNKS} group by doc")
def stored_ordinals(spark, sf_dir):
    return C.ordinals(chunks(spark, sf_dir))


@plans.add("a30_n09_list_documents", f"select doc, id from {CHUNKS} where ordinal = 0 or ordinal is null")
def documents(spark, sf_dir):
    return C.one_per_document(chunks(spark, sf_dir)).select("doc", "id")


@plans.add("a27_a28_f13_keyset_page", "select o_custkey, o_orderkey, o_totalprice from orders where (o_custkey, o_orderkey) > (100, 500) order by 1, 2 limit 50")
def page(spark, sf_dir):
    return C.page_after(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderkey"], [100, 500], 50)


@plans.add("f14_f15_list_page", "select o_orderkey from orders order by o_orderkey limit 200 offset 20")
def offset_page(spark, sf_dir):
    from plinth.operators.progress import list_limit, list_offset

    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").offset(list_offset("20")).limit(list_limit("x"))


@plans.add("a29_all_ids", f"select distinct doc from {CHUNKS}")
def all_ids(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc").distinct()


@plans.add("a32_ids_by_paths", f"select id from {CHUNKS} where path in ('A', 'N')")
def by_paths(spark, sf_dir):
    return C.by_keys(chunks(spark, sf_dir), literal(spark, "path string", [("A",), ("N",)]), "path").select("id")


@plans.add("a33_ids_exist", literal_sql(["probe", "there"], [("present", True), ("absent", False)]))
def exist(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return literal(spark, "probe string, there boolean", [("present", C.all_exist(orders, orders.filter("id % 7 = 0"), "id")), ("absent", C.all_exist(orders, orders.select((F.col("id") + 10**9).alias("id")), "id"))])


@plans.add("a34_a35_d17_n11_counts", "select 'orders' as source, count(*) as n from orders union all select 'lineitem', count(*) from lineitem union all select 'all', (select count(*) from orders) + (select count(*) from lineitem)")
def counts(spark, sf_dir):
    each = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("source"), "n") for t in ("orders", "lineitem")]
    both = each[0].unionAll(each[1])
    return both.unionAll(both.agg(F.sum("n").alias("n")).select(F.lit("all").alias("source"), "n"))


@plans.add("a26_absent_is_empty", "select 0::bigint as n")
def absent(spark, sf_dir):
    return C.or_empty(spark, "no_such_table_here", table(spark, sf_dir, "orders").schema).agg(F.count("*").alias("n"))


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("price"))


def versioned(spark, rows, key, buckets=8, indexed=None):
    """rows as a versioned table in a new folder."""
    from plinth.sources.files import scratch

    made = V.VersionedTable(spark, f"{scratch(spark)}/table", indexed)
    made.upsert(rows, key, buckets)
    return made


@plans.add("a36_a37_a38_upsert", "select o_orderkey as id, case when o_orderkey % 30 < 10 then 'X' || (o_orderkey % 30) when o_orderkey % 30 < 20 then 'Y' else o_orderstatus end as state, case when o_orderkey % 30 < 10 then o_totalprice + 1 when o_orderkey % 30 < 20 then 1.5 else o_totalprice end as price from orders union all select -o_orderkey, 'N', 0.5 from orders where o_orderkey % 30 in (3, 17)")
def upserted(spark, sf_dir):
    """Ten batches of upserts, of which the later ones write some rows again, and a compaction among them."""
    o = orders(spark, sf_dir)
    made = versioned(spark, o, ["id"])
    made.upsert(o.filter("id % 30 < 20").select("id", F.lit("Y").alias("state"), F.lit(1.5).alias("price")))
    for i in range(10):
        rows = o.filter(F.col("id") % 30 == i).select("id", F.lit(f"X{i}").alias("state"), (F.col("price") + 1).alias("price"))
        if i == 3:
            rows = rows.unionByName(o.filter("id % 30 in (3, 17)").select((-F.col("id")).alias("id"), F.lit("N").alias("state"), F.lit(0.5).alias("price")))
        made.upsert(rows)
        if i == 5:
            made.compact(most_deltas=4)
    return made.read()


@plans.add("a36_last_write_wins", "select o_custkey as id, max(o_orderkey) as seq from orders group by o_custkey")
def last_write(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"))
    return C.latest(o, ["id"], [F.desc("seq")])


@plans.add("a39_overwrite_payload", "select o_orderkey as id, case when o_orderkey % 5 = 0 then 'new' else o_orderstatus end as state, o_totalprice as price from orders")
def payload(spark, sf_dir):
    """New payload for stored rows, which keep their other columns; made again if its buckets change meanwhile."""
    o = orders(spark, sf_dir)
    new = o.filter("id % 5 = 0").select("id", F.lit("new").alias("state")).unionByName(o.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("none").alias("state")))
    made = versioned(spark, o, ["id"])
    made.change(lambda now: (C.fresh_payload(now, new, "id", ["price"]), None), depends="own")
    return made.read()


@plans.add("a40_a41_delete_by_keys", "select o_orderkey as id from orders where o_orderstatus <> 'F' and o_orderkey % 4 <> 0")
def deleted(spark, sf_dir):
    o = orders(spark, sf_dir)
    made = versioned(spark, o, ["id"])
    made.change(lambda now: (None, C.by_keys(now, literal(spark, "state string", [("F",)]), "state")))
    made.delete(o.filter("id % 4 = 0").select("id"))
    return made.read().select("id")


@plans.add("a42_l13_delete_tail", f"select id from {CHUNKS} where ordinal is null or ordinal < doc % 3 + 1 or doc % 2 = 0")
def tail(spark, sf_dir):
    c = chunks(spark, sf_dir)
    keep = c.filter("doc % 2 = 1").select("doc", (F.col("doc") % 3 + 1).alias("chunks")).distinct()
    made = versioned(spark, c, ["id"])
    made.change(lambda now: (None, now.join(C.delete_tail(now, keep).select("id"), "id", "left_anti")))
    return made.read().select("id")


@plans.add("a43_delete_unnumbered", f"select count(*) filter (where ordinal is not null) as kept, count(*) filter (where ordinal is null) as deleted from {CHUNKS}")
def unnumbered(spark, sf_dir):
    return chunks(spark, sf_dir).agg(F.count_if(F.col("ordinal").isNotNull()).alias("kept"), F.count_if(F.col("ordinal").isNull()).alias("deleted"))


@plans.add("a47_copy", "select count(*) as n, sum(o_orderkey) as total from orders")
def copied(spark, sf_dir):
    from plinth.sources.files import scratch

    path = f"{scratch(spark)}/copy"
    table(spark, sf_dir, "orders").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@plans.add("a44_a46_a48_a49_j25_j26_publish", "select count(*) as served, count(*) as restored, 0::bigint as after_reset, true as conflict, count(*) as first_version from orders where o_orderkey % 2 = 0")
def published(spark, sf_dir):
    """A version that lacks rows, and one made from an older version, aren't served; archives are checked; older versions stay readable until they expire."""
    even = orders(spark, sf_dir).filter("id % 2 = 0")
    made, n, conflict = versioned(spark, even, ["id"]), even.count(), False
    for rows, made_from, expected in ((even.limit(0), None, n), (even, 1, n), (even, 1, n)):
        try:
            made.replace(rows, made_from=made_from, expected=expected)
        except V.Conflict:
            conflict = True
        except ValueError:
            pass
    served = made.read().count()
    C.archive(made.read(), f"{made.base}-archive", served)
    back = C.restore(spark, f"{made.base}-archive").count()
    first = made.read(version=1).count()
    made.reset()
    return literal(spark, "served long, restored long, after_reset long, conflict boolean, first_version long", [(served, back, made.read().count(), conflict, first)])


@plans.add("a25_a32_a40_indexed_fields", "select o_orderkey as id from orders where o_orderpriority = '1-URGENT' and o_custkey % 50 in (3, 7) and not (o_orderkey % 11 = 0)")
def indexed_fields(spark, sf_dir):
    """Filters by a field and by an element of a list, which are looked up in the files' indexes first; some rows have changed since."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("path"), F.array(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")), F.lit("all")).alias("tags"))
    made = versioned(spark, o, ["id"], indexed=["path", "tags"])
    made.upsert(o.filter("id % 11 = 0").withColumn("path", F.lit("gone")))
    return made.read(holding={"path": ["1-URGENT"], "tags": ["c3", "c7"]}).select("id")


@plans.add("c02_c03_c18_adopt_vectors", """select s.s_suppkey as id, case when s.s_suppkey % 5 = 0 then null when s.s_suppkey % 3 = 0 then 1 when s.s_suppkey % 2 = 0 then 2 end as donor from supplier s""")
def adopted(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("content"))
    vec = F.array(F.lit(1.0))
    first = s.filter("id % 3 = 0").select("id", F.lit(1).alias("rank"), F.when(F.col("id") % 5 == 0, "other").otherwise(F.col("content")).alias("content"), vec.alias("dense"), vec.alias("sparse"))
    second = s.filter("id % 2 = 0").select("id", F.lit(2).alias("rank"), "content", F.when(F.col("id") % 5 != 0, vec).alias("dense"), F.lit(None).cast("array<double>").alias("sparse"))
    return C.adopt_vectors(s, first.unionByName(second)).select("id", "donor")


@plans.add("d14_reuse_rate", "select count(*) filter (where s_suppkey % 3 = 0) as hits, count(*) filter (where s_suppkey % 3 <> 0) as misses, round(count(*) filter (where s_suppkey % 3 = 0) / count(*), 6) as hit_rate, round(count(*) filter (where s_suppkey % 3 = 0) * 0.02::double, 6) as saved_seconds from supplier")
def reuse(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(1.0))).alias("dense"))
    return C.reuse_rate(s).select("hits", "misses", F.round("hit_rate", 6).alias("hit_rate"), F.round("saved_seconds", 6).alias("saved_seconds"))


@plans.add("g03_b26_incremental_diff", "select coalesce(a.o_orderkey, b.l_orderkey) as id, case when b.l_orderkey is null then 'new' when a.o_orderkey is null then 'deleted' else 'candidate' end as change from (select o_orderkey from orders where o_orderkey % 3 <> 0) a full outer join (select distinct l_orderkey from lineitem where l_shipdate < '1995-06-01') b on a.o_orderkey = b.l_orderkey")
def diff(spark, sf_dir):
    now = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"))
    return C.difference(now, table(spark, sf_dir, "lineitem").filter("l_shipdate < '1995-06-01'").select(F.col("l_orderkey").alias("id")), "id")


@plans.add("g04_delete_obsolete", "select l_orderkey || '-' || l_linenumber as id, l_returnflag as path from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def obsolete(spark, sf_dir):
    prior = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_returnflag").alias("path"), "l_orderkey")
    shown = prior.join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return C.obsolete(prior.select("id", "path"), shown)


@plans.add("g05_rollback", "select o_orderkey as id from orders where o_orderkey % 2 <> 0 and o_orderkey % 3 <> 0")
def rolled_back(spark, sf_dir):
    o = orders(spark, sf_dir)
    return C.rollback(o, o.filter("id % 2 = 0"), o.filter("id % 3 = 0"))


@plans.add("g02_prune_evidence", "select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def pruned(spark, sf_dir):
    return C.by_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k").withColumnRenamed("k", "c_custkey")


@plans.add("g09_j04_merge_observations", "select user_id as root, event_type as path, min(ts) as first_at, max(ts) as latest_at, list_sort(list(distinct case when value > 50 then 'modify' else 'add' end)) as kinds from events group by 1, 2")
def observations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("root"), F.col("event_type").alias("path"), F.col("ts").alias("first_at"), F.col("ts").alias("latest_at"), F.array(F.when(F.col("value") > 50, "modify").otherwise("add")).alias("kinds"), "event_id")
    return C.merge_observations(e.filter("event_id % 2 = 0").drop("event_id"), e.filter("event_id % 2 = 1").drop("event_id"))


@plans.add("j13_restore_captured", "select o_orderkey as path, case when o_orderkey % 2 = 0 then 'pending' else 'captured' end as kind from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def captured(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    return C.restore_captured(o.filter("path % 3 = 0").withColumn("kind", F.lit("captured")), o.filter("path % 2 = 0").withColumn("kind", F.lit("pending")))


@plans.add("j22_payload_refresh_plan", f"select o.o_orderkey as doc, case when c.nulls = 0 and c.d = o.o_orderkey % 5 + 1 and c.lo = 0 and c.hi = o.o_orderkey % 5 then 'refresh' else 'defer' end as action from orders o left join (select doc, count(distinct ordinal) as d, min(ordinal) as lo, max(ordinal) as hi, count(*) filter (where ordinal is null) as nulls from {CHUNKS} group by doc) c on c.doc = o.o_orderkey")
def refresh(spark, sf_dir):
    planned = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 5 + 1).alias("chunks"))
    return C.payload_refresh(chunks(spark, sf_dir), planned)


_AUDIT = "(select coalesce(o.o_orderkey, l.l_orderkey) as id, case when o.o_orderkey is null then 'missing' when o.o_orderkey % 13 = 0 then 'foreign' when l.l_orderkey is null then 'extra' when l.n % 2 = o.o_orderkey % 2 then 'matched' else 'incompatible' end as verdict from orders o full outer join (select l_orderkey + (case when l_orderkey % 17 = 0 then 1000000 else 0 end) as l_orderkey, count(*) as n from lineitem group by 1) l on l.l_orderkey = o.o_orderkey)"


@plans.add("c14_classify_audit", f"select id, verdict from {_AUDIT}")
def audited(spark, sf_dir):
    return C.audit(*audit_sides(spark, sf_dir))


def audit_sides(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 13 != 0).alias("owner"), (F.col("o_orderkey") % 2).alias("digest"))
    proof = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") + F.when(F.col("l_orderkey") % 17 == 0, 1000000).otherwise(0)).alias("id")).agg((F.count("*") % 2).alias("digest"))
    return stored, proof


@plans.add("l03_audit_result", "select " + ", ".join(f"count(*) filter (where verdict = '{v}') as {v}" for v in ("matched", "extra", "foreign", "incompatible", "missing")) + f", case when count(*) filter (where verdict <> 'matched') = 0 then 'consistent' else 'drift' end as result from {_AUDIT}")
def audit_total(spark, sf_dir):
    return C.audit_result(audited(spark, sf_dir))


@plans.add("c14_l03_audit_by_digests", "select " + ", ".join(f"count(*) filter (where verdict = '{v}') as {v}" for v in ("matched", "extra", "foreign", "incompatible", "missing")) + f", case when count(*) filter (where verdict <> 'matched') = 0 then 'consistent' else 'drift' end as result from {_AUDIT}")
def audit_by_digests(spark, sf_dir):
    """The audit's counts, for which only the ranges whose digests differ are joined."""
    from plinth.operators import digests as D
    from plinth.sources.files import scratch

    stored, proof = audit_sides(spark, sf_dir)
    top = scratch(spark)
    return D.result(D.write(stored, f"{top}/stored", 64, 8), D.write(proof, f"{top}/proof", 64, 8))


# Ledger

SEGMENTS = "(select l_orderkey as k, l_linenumber - 1 as ordinal, l_linenumber = max(l_linenumber) over (partition by l_orderkey) as last, l_quantity as size, l_returnflag as kind from lineitem)"


def segments(spark, sf_dir):
    from pyspark.sql import Window

    top = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("ordinal"), (F.col("l_linenumber") == top).alias("last"), F.col("l_quantity").alias("size"), F.col("l_returnflag").alias("kind"))


_BROKEN = f"(select k, count(*) as n, min(ordinal) as lo, max(ordinal) as hi from {SEGMENTS} group by k having min(ordinal) <> 0 or max(ordinal) <> count(*) - 1 or sum(ordinal) <> count(*) * (count(*) - 1) / 2 or sum(last::int) <> 1 or max(case when last then ordinal end) is distinct from count(*) - 1)"


@plans.add("d06_segment_contiguity", f"select * from {_BROKEN}")
def contiguity(spark, sf_dir):
    return L.broken_segments(segments(spark, sf_dir), "k")


@plans.add("d07_completion_evidence", f"select kind, k % 10 as part, count(*) as n, min(ordinal) as lo, max(ordinal) as hi, round(sum(size), 4) as size, max(case when last then ordinal end) as end_at from {SEGMENTS} group by all")
def completion(spark, sf_dir):
    out = L.completion(segments(spark, sf_dir).withColumn("part", F.col("k") % 10), ["kind", "part"])
    return out.withColumn("size", F.round("size", 4))


@plans.add("d08_unconfirmed", "select count(*) filter (where o_orderstatus <> 'F') as unconfirmed from orders")
def unconfirmed(spark, sf_dir):
    return L.unconfirmed(orders(spark, sf_dir), "F")


@plans.add("c06_left_anti", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def anti(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.missing(table(spark, sf_dir, "orders").select("o_orderkey"), lines, ["o_orderkey"])


@plans.add("c07_not_exists_keys", "select distinct l_orderkey, l_suppkey from lineitem l where not exists (select 1 from lineitem m where m.l_orderkey = l.l_orderkey and m.l_suppkey = l.l_suppkey and m.l_linestatus = 'F')")
def anti_keys(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return L.missing(l.select("l_orderkey", "l_suppkey").distinct(), l.filter("l_linestatus = 'F'"), ["l_orderkey", "l_suppkey"])


@plans.add("c08_exists_columns", "select o_orderkey, exists(select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as returned from orders")
def exists(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.with_exists(table(spark, sf_dir, "orders").select("o_orderkey"), "returned", lines, ["o_orderkey"])


@plans.add("c09_inner_chain", "select o_orderkey, l_linenumber, p_brand from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where o_totalprice > 300000")
def chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_orderkey")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return o.join(l, "o_orderkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").select("o_orderkey", "l_linenumber", "p_brand")


@plans.add("c10_left_outer", "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey")
def outer(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "left")


@plans.add("c05_readiness_checks", f"""select 'contiguous' as "check", count(*) as failures from {_BROKEN} union all
  select 'counts', count(*) from (select o_orderkey from orders left join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'F' group by o_orderkey having count(l_orderkey) <> o_orderkey % 4 + 2) union all
  select 'no_units', count(*) from orders where o_orderstatus <> 'F' and o_orderkey not in (select l_orderkey from lineitem) union all
  select 'no_file', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all
  select 'overlap', count(*) from orders where o_orderstatus = 'F' and o_orderkey in (select l_orderkey from lineitem)""")
def ready(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("kept").alias("state"), (F.col("o_orderkey") % 4 + 2).alias("expected"))
    return L.readiness(files, segments(spark, sf_dir), segments(spark, sf_dir).select("k", F.col("ordinal").alias("id")), "k")


@plans.add("e01_l14_history_retention", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate desc, o_orderkey desc) <= 3")
def history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    return L.retained(o, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@plans.add("g01_union_all_deltas", "select n_name as path, r_name as target from nation join region on r_regionkey = n_regionkey where n_name = 'NATION_1' or (r_name = 'ASIA' and n_name <> 'ASIA')")
def union_deltas(spark, sf_dir):
    d = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("path"), F.col("r_name").alias("target"))
    return L.deltas_by_path(d, "ASIA").unionAll(d.filter("path = 'NATION_1' and target <> 'ASIA'"))


@plans.add("d15_fold_deltas", "select l_returnflag as kind, count(*) as identities, sum(l_linenumber) as points from lineitem group by 1")
def folded(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.lit(1).cast("long").alias("identities"), F.col("l_linenumber").cast("long").alias("points"))
    return L.fold_deltas(d, "kind")


@plans.add("c16_f12_rank_donors", "select s_name as prefix, row_number() over (order by s_nationkey, s_acctbal desc, s_name) as rank from supplier where s_suppkey <> 5 qualify rank <= 3")
def donors(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("root"), F.lit("server").alias("backend"), F.col("s_nationkey").alias("family"), F.col("s_acctbal").alias("last_indexed"), F.col("s_name").alias("prefix"))
    return L.rank_donors(c, "5", "server").filter("rank <= 3").select("prefix", "rank")


@plans.add("c17_donor_gates", "select s_suppkey, list_filter([case when not s_acctbal > 0 then 'balance' end, case when not s_nationkey < 10 then 'nation' end, case when not s_suppkey % 2 = 0 then 'even' end], lambda x: x is not null) as failed from supplier")
def gates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return L.failed_gates(s, {"balance": F.col("s_acctbal") > 0, "nation": F.col("s_nationkey") < 10, "even": F.col("s_suppkey") % 2 == 0}).select("s_suppkey", "failed")
