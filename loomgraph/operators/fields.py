"""Members and field accesses: what methods read, write and call, and clusters of methods that share fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import trailing_identifier
from loomgraph.graph import Graph
from loomgraph.scratch import materialize

WEIGHT_READ, WEIGHT_WRITE, WEIGHT_BOTH, LEAST_SIMILARITY = 0.3, 1.0, 1.5, 0.20
#: Members of a block whose pairs are made at a time, and pairs that a task makes.
BLOCK, TASK_PAIRS = 1000, 4_000_000
CLUSTERS = "cluster int, node_id bigint, name string, lines int, reads bigint, writes bigint, extractability double, shared_fields string, total_fields string, avg_extractability double"


def field_use(g: Graph, node_id: int | None = None) -> DataFrame:
    """(node_id, name, reads, writes, first_line) of the fields a method, or every method, uses."""
    r = g.refs.where("kind = 'field_access' AND containing_node_id IS NOT NULL")
    if node_id is not None:
        r = r.where(F.col("containing_node_id") == node_id)
    write = F.col("evidence") == "this_member_write"
    return r.groupBy(F.col("containing_node_id").alias("node_id"), "name").agg(F.sum(F.when(write, 0).otherwise(1)).alias("reads"), F.sum(F.when(write, 1).otherwise(0)).alias("writes"), F.min("start_line").alias("first_line"))


def sibling_names(g: Graph, node_id: int) -> DataFrame:
    """Names of the members that lie in the same containers as a node."""
    up = g.edges.where((F.col("kind") == "contains") & (F.col("dst_id") == node_id)).select("src_id")
    down = g.edges.where("kind = 'contains'").join(up, "src_id", "left_semi").select(F.col("dst_id").alias("id"))
    return g.nodes.join(down, "id", "left_semi").select("name").distinct()


def method_calls(g: Graph, node_id: int) -> DataFrame:
    """(name, relationship, count, first_line) of a method's calls: self if a sibling has the name and no other receiver stands before it."""
    calls = g.refs.where((F.col("kind") == "call") & (F.col("containing_node_id") == node_id))
    own = F.regexp_replace("name", r"^(?:this|self)(?:\.|->)", "")
    rows = calls.groupBy(own.alias("name")).agg(F.count(F.lit(1)).alias("count"), F.min("start_line").alias("first_line"))
    near = sibling_names(g, node_id).withColumnRenamed("name", "sibling")
    return rows.join(near, F.col("name") == F.col("sibling"), "left").select("name", F.when(F.col("sibling").isNotNull(), "self").otherwise("external").alias("relationship"), "count", "first_line")


def extractability(g: Graph) -> DataFrame:
    """(node_id, reads, writes, extractability): the share of reads among a method's accesses, 1 without any."""
    use = field_use(g)
    sums = use.groupBy("node_id").agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes"))
    total = F.col("reads") + F.col("writes")
    return sums.withColumn("extractability", F.when(total == 0, 1.0).otherwise(F.col("reads") / total))


def weighted_fields(g: Graph) -> DataFrame:
    """(node_id, name, weight) of each method and field."""
    both = (F.col("reads") > 0) & (F.col("writes") > 0)
    return field_use(g).select("node_id", "name", F.when(both, WEIGHT_BOTH).when(F.col("writes") > 0, WEIGHT_WRITE).otherwise(WEIGHT_READ).alias("weight"))


def containers(g: Graph) -> DataFrame:
    """(node_id, container): the least symbol that contains a node, else its file (as a negative id)."""
    up = g.edges.where("kind = 'contains'").join(g.nodes.where("node_type = 'symbol'").select(F.col("id").alias("src_id")), "src_id", "left_semi").groupBy(F.col("dst_id").alias("node_id")).agg(F.min("src_id").alias("up"))
    rows = g.nodes.where("node_type = 'symbol'").select(F.col("id").alias("node_id"), "file_id").join(up, "node_id", "left")
    return rows.select("node_id", F.coalesce("up", -F.col("file_id") - 1).alias("container")).where("container IS NOT NULL")


def _blocks(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Rows with ``block`` and ``blocks``: those of equal keys dealt by hash to blocks of about ``BLOCK`` members."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    return rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")))


def _meetings(rows: DataFrame, keys: list[str], member: str) -> tuple[DataFrame, DataFrame]:
    """Rows twice, with ``i`` and ``j``: of equal keys, each two blocks (and each with itself) meet once, so a key's pairs are made by many tasks of bounded size."""
    dealt = _blocks(rows, keys, member)
    left = dealt.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).drop("block", "blocks")
    right = dealt.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block")))).drop("block", "blocks")
    return left, right


def similarity(g: Graph, scope: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity), a < b: weighted Jaccard of the fields of methods of one container that share a field.

    ``scope`` (node_id, container) says which methods are compared; by default
    those of one class, or of one file. Fields of equal names in other
    containers are other fields, so a common name makes no large group. The
    sum of maxima is the sum of both weights less the sum of minima, so only
    shared fields are joined.

    Methods of a container with equal fields and weights have one profile:
    profiles are compared, and each two of them stand for all pairs of their
    methods. There are as many rows as pairs, but pairs are neither shuffled
    nor grouped: blocks of methods are, and the tasks that write spell them out.
    """
    f = weighted_fields(g).join(containers(g) if scope is None else scope, "node_id").where("container IS NOT NULL")
    methods = f.groupBy("container", "node_id").agg(F.sort_array(F.collect_list(F.struct("name", "weight"))).alias("fields"))
    methods = materialize(methods.withColumn("profile", F.unhex(F.sha2(F.to_json("fields"), 256))), "methods")
    total = F.aggregate("fields", F.lit(0.0), lambda sum_, x: sum_ + x["weight"])
    profiles = methods.select("container", "profile", "fields").distinct().select("container", "profile", total.alias("total"), F.inline("fields")).where("name IS NOT NULL")
    x, y = _meetings(profiles, ["container", "name"], "profile")
    y = y.select("container", "name", "i", "j", F.col("profile").alias("other"), F.col("weight").alias("other_weight"), F.col("total").alias("other_total"))
    met = x.join(y, ["container", "name", "i", "j"]).where("i < j OR profile <= other")
    # of two blocks the lesser profile may lie in either, by the name's hash: put in order before they are grouped
    less = F.col("profile") <= F.col("other")
    met = met.select("container", F.least("profile", "other").alias("profile"), F.greatest("profile", "other").alias("other"), F.when(less, F.col("total")).otherwise(F.col("other_total")).alias("total"), F.when(less, F.col("other_total")).otherwise(F.col("total")).alias("other_total"), F.least("weight", "other_weight").alias("low"))
    alike = met.groupBy("container", "profile", "other", "total", "other_total").agg(F.sum("low").alias("low"))
    alike = alike.select("container", "profile", "other", (F.col("low") / (F.col("total") + F.col("other_total") - F.col("low"))).alias("similarity"))

    members = _blocks(methods.select("container", "profile", "node_id"), ["container", "profile"], "node_id").groupBy("container", "profile", "block").agg(F.collect_list("node_id").alias("ids"))
    members = materialize(members, "members")
    units = alike.join(members, ["container", "profile"]).join(members.select("container", F.col("profile").alias("other"), F.col("block").alias("other_block"), F.col("ids").alias("other_ids")), ["container", "other"])
    units = materialize(units.where("profile < other OR block <= other_block").select("ids", "other_ids", "similarity", ((F.col("profile") == F.col("other")) & (F.col("block") == F.col("other_block"))).alias("same")), "units")
    pairs = units.agg(F.coalesce(F.sum(F.size("ids").cast("bigint") * F.size("other_ids")), F.lit(0))).first()[0]
    each = units.repartition(pairs // TASK_PAIRS + 1).select(F.explode("ids").alias("one"), "other_ids", "similarity", "same")
    each = each.select("one", F.explode("other_ids").alias("two"), "similarity", "same").where("NOT same OR one < two")
    return each.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), "similarity")


def greedy_clusters(methods: list[dict]) -> list[dict]:
    """Methods in line order, each with the first cluster whose seed is similar enough; a seed has two fields at least."""
    clusters: list[dict] = []
    for m in methods:
        for c in clusters:
            s = c["seed"]["fields"]
            names = set(s) | set(m["fields"])
            low = sum(min(s.get(n, 0.0), m["fields"].get(n, 0.0)) for n in names)
            high = sum(max(s.get(n, 0.0), m["fields"].get(n, 0.0)) for n in names)
            if high and low / high >= LEAST_SIMILARITY:
                c["members"].append(m)
                break
        else:
            if len(m["fields"]) >= 2:
                clusters.append({"seed": m, "members": [m]})
    for c in clusters:
        sets = [set(m["fields"]) for m in c["members"]]
        c["shared"], c["total"] = sorted(set.intersection(*sets)), sorted(set.union(*sets))
        c["mean"] = sum(m["extractability"] for m in c["members"]) / len(c["members"])
    return sorted(clusters, key=lambda c: -c["mean"])


def dependency_clusters(g: Graph, key: str = "file_id", only: int | None = None) -> DataFrame:
    """Clusters of methods by shared fields, for every file (or one); each file's methods are one group."""
    m = g.nodes.where(F.col("kind").isin("method", "function") & F.col("file_id").isNotNull())
    if only is not None:
        m = m.where(F.col(key) == only)
    method_names = m.select(F.col(key).alias("__k"), F.col("name").alias("__name")).distinct()
    use = field_use(g).withColumnRenamed("name", "field").join(m.select(F.col("id").alias("node_id"), F.col(key).alias("grp"), F.col("name").alias("method"), "start_line", "end_line"), "node_id")
    use = use.join(method_names, (F.col("grp") == F.col("__k")) & (trailing_identifier(F.col("field")) == F.col("__name")), "left_anti")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        methods = []
        for (line, node), part in pdf.sort_values(["start_line", "node_id"]).groupby(["start_line", "node_id"], sort=True):
            fields = {r.field: WEIGHT_BOTH if r.reads and r.writes else WEIGHT_WRITE if r.writes else WEIGHT_READ for r in part.itertuples()}
            reads, writes = int(part.reads.sum()), int(part.writes.sum())
            r = part.iloc[0]
            methods.append({"id": int(node), "name": r.method, "lines": int(r.end_line - line + 1), "fields": fields, "reads": reads, "writes": writes, "extractability": reads / (reads + writes) if reads + writes else 1.0})
        rows = [(i, m["id"], m["name"], m["lines"], m["reads"], m["writes"], m["extractability"], ",".join(c["shared"]), ",".join(c["total"]), c["mean"]) for i, c in enumerate(greedy_clusters(methods)) for m in c["members"]]
        return pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in CLUSTERS.split(",")])

    return use.groupBy("grp").applyInPandas(run, CLUSTERS)
