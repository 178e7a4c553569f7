"""SQL lineage walked backwards, the edges that it adds, and the life cycle of requests."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..session import written as cut

# Relations that access a table, that a walk follows backwards, that a request follows; node types of stores and their tiers.
ACCESSES = ["QUERIES_TABLE", "WRITES_TABLE", "CREATES_TABLE", "READS_FROM", "READS_COLLECTION", "WRITES_COLLECTION"]
FOLLOWED = ["CALLS", "INVOKES", "CONTAINS", "DEFINES", "CALLS_API", "INVOKES_SERVICE"]
FLOWS = ["CALLS", "INVOKES", "CALLS_API", "INVOKES_METHOD", "INVOKES_SERVICE", "INVOKES_API", "EXECUTES_AFTER", "CONTROL_FLOW", "DEPENDS_ON"]
DATA_ACCESS = ["QUERIES_TABLE", "WRITES_TABLE", "CREATES_TABLE", "READS_FROM", "WRITES_TO", "READS_COLLECTION", "WRITES_COLLECTION", "AGGREGATES_COLLECTION"]
DATA_TYPES = ["SQL_TABLE", "MONGO_COLLECTION", "DATAFRAME"]
TIERS = {"API_ENDPOINT": "Controller", "CONTROLLER": "Controller", "SERVICE": "Service", "REPOSITORY": "Repository", "SQL_TABLE": "Database", "MONGO_COLLECTION": "Database", "DATAFRAME": "Database", "FUNCTION": "Function", "ASYNC_FUNCTION": "Function", "METHOD": "Function", "CLASS": "Component"}


def placed(df: DataFrame, key: str) -> DataFrame:
    """``df`` laid out by ``key`` in the order of it, kept on the executors' disks: a loop that joins it each round moves only the other side.

    A lost executor's part is made again from what ``df`` reads. The caller lets go of it by ``unpersist``.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)


def tier() -> F.Column:
    """The tier of a node by its type."""
    return F.coalesce(*(F.when(F.col("node_type") == k, F.lit(v)) for k, v in TIERS.items()), F.lit("Other"))


TOLD = "array<struct<name:string,tier:string>>"


def predecessors(edges: DataFrame, relations: list[str], most: int, nodes: DataFrame | None = None) -> DataFrame:
    """id, before, told: the ``most`` best nodes before each node, best first: the last of those that call it, then the first of the others.

    told holds name and tier of the node itself where ``nodes`` (id, name, tier) has it. The stored order of a node's edges is that
    of (from_id, relation). One shuffle: a node that both calls and holds another counts twice until the list is made, so twice
    ``most`` places are kept; tasks drop a hub's later rows before the shuffle.
    """
    told = F.lit(None).cast("struct<name:string,tier:string>").alias("told")
    rows = edges.where(F.col("relation").isin(*relations)).select(F.col("to_id").alias("id"), "from_id", (F.col("relation") == "CALLS").alias("calls"), told)
    if nodes is not None:
        rows = rows.unionByName(nodes.select("id", F.lit(None).cast("string").alias("from_id"), F.lit(None).cast("boolean").alias("calls"), F.struct("name", "tier").alias("told")))
    w = Window.partitionBy("id").orderBy(F.desc_nulls_first("calls"), F.when(F.col("calls"), F.col("from_id")).desc(), "from_id")
    top = rows.withColumn("n", F.dense_rank().over(w)).where(F.col("n") <= 2 * most + 1)  # a node's own row is the first
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lists = top.select("id", F.collect_list("from_id").over(whole).alias("before"), F.collect_list("told").over(whole).alias("told"), F.row_number().over(w).alias("k"))
    return lists.where("k = 1").select("id", F.slice(F.array_distinct("before"), 1, most).alias("before"), F.array_distinct("told").alias("told"))


def walks_back(edges: DataFrame, starts: DataFrame, relations: list[str] = FOLLOWED, depth: int = 15, nodes: DataFrame | None = None) -> DataFrame:
    """id, path, told: from each of ``starts`` (id) the greedy walk against the edges, the start last.

    A step takes the best node before that the walk hasn't met. A walk has met ``depth`` others at most, so the ``depth`` + 1
    best ones of each node are all that it can need: a step joins one row a node, whatever its edges. The row that tells the next
    step also tells the node's name and tier (``nodes``), so told has those of the path's nodes without another join.
    """
    before = placed(predecessors(edges, relations, depth + 1, nodes).withColumnRenamed("id", "at").withColumnRenamed("told", "own"), "at")
    going = starts.select("id").distinct().select("id", F.col("id").alias("at"), F.array("id").alias("path"), F.array().cast(TOLD).alias("told"))
    done = []
    for i in range(depth + 1):
        met = going.join(before, "at", "left")
        # after the last step a walk only hears the name of the node that it has come to
        new = F.get(F.filter("before", lambda x: ~F.array_contains("path", x)), F.lit(0)) if i < depth else F.lit(None).cast("string")
        told = F.concat(F.coalesce("own", F.array().cast(TOLD)), "told")
        step = cut(met.select("id", new.alias("at"), F.when(new.isNull(), F.col("path")).otherwise(F.concat(F.array(new), "path")).alias("path"), told.alias("told")))
        done.append(step.where("at is null").select("id", "path", "told"))
        going = step.where("at is not null")
        if going.isEmpty():
            break
    before.unpersist()
    return reduce(DataFrame.unionByName, done)


def sql_lineage(g: Graph, depth: int = 15, tell: bool = True) -> DataFrame:
    """table_id, accessor, relation, confidence, path: for every access to a table the chain of callers, the accessor and the table.

    A walk hangs on the accessor alone, so one walk serves all its accesses. With ``tell`` also told (name and tier of the path's
    nodes that exist), and the names of table and accessor.
    """
    tables = g.nodes.where("node_type = 'SQL_TABLE'").select(F.col("id").alias("to_id"), F.col("name").alias("table_name"), F.struct("name", tier().alias("tier")).alias("end")).distinct()
    access = g.edges.where(F.col("relation").isin(*ACCESSES)).join(tables, "to_id")
    access = access.join(g.nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    access = cut(access.groupBy("from_id", "to_id", "relation", "table_name", "end").agg(F.min("confidence").alias("confidence")))
    walks = walks_back(g.edges, access.select(F.col("from_id").alias("id")), depth=depth, nodes=g.nodes.select("id", "name", tier().alias("tier")) if tell else None)
    chains = access.join(walks.withColumnRenamed("id", "from_id"), "from_id")
    more = [F.concat("told", F.array("end")).alias("told"), "table_name", F.try_element_at("told", F.lit(-1))["name"].alias("accessor_name")] if tell else []
    return chains.select(F.col("to_id").alias("table_id"), F.col("from_id").alias("accessor"), "relation", "confidence", F.concat("path", F.array("to_id")).alias("path"), *more)


def lineage_edges(chains: DataFrame) -> DataFrame:
    """from_id, to_id, relation, confidence: FEEDS_DATA_TO from the first to the last node of each chain, once, as the first chain (by table, accessor, relation) says."""
    ends = chains.select(F.get("path", F.lit(0)).alias("from_id"), F.try_element_at("path", F.lit(-1)).alias("to_id"), "confidence", F.struct("table_id", "accessor", "relation").alias("at"))
    return ends.where("from_id <> to_id").groupBy("from_id", "to_id").agg(F.min_by("confidence", "at").alias("confidence")).withColumn("relation", F.lit("FEEDS_DATA_TO"))


# --- requests --------------------------------------------------------------------------
def until_data(g: Graph, starts: DataFrame, depth: int = 8) -> DataFrame:
    """seed, id, step, name, tier: the nodes that a breadth-first search from each start (id) meets, up to and with the first data node.

    A level goes in the order in which its nodes were first met: by the place of the node before, then to_id. A search that has met
    a data node goes no further, nor does one whose level is empty. Nodes that don't exist aren't met. A round moves only the
    searches that still go on: what they have met and what they meet now come together once, by search. Repeated nodes and edges count once.
    """
    kinds = g.nodes.select("id", "name", tier().alias("tier"), F.col("node_type").isin(*DATA_TYPES).alias("data")).repartition("id").distinct()
    e = g.edges.where(F.col("relation").isin(*FLOWS, *DATA_ACCESS)).select("from_id", "to_id").join(kinds.withColumnRenamed("id", "to_id"), "to_id")
    e = placed(e, "from_id")
    node = ["id", "name", "tier", "data"]
    first = F.lit(1).cast("long")
    level = cut(starts.select("id").distinct().join(kinds, "id").select(F.col("id").alias("seed"), *node, first.alias("step"), F.lit(True).alias("fresh"), F.col("data").alias("over")))
    over = [level.where("over")]
    going = level.where("not over")
    by = Window.partitionBy("seed")
    for _ in range(depth):
        if going.isEmpty():
            break
        new = going.where("fresh").select("seed", F.col("id").alias("from_id"), "step").join(e, "from_id")
        new = new.select("seed", F.col("to_id").alias("id"), *node[1:], F.lit(None).cast("long").alias("old"), F.col("step").alias("from_step"))
        met = going.select("seed", *node, F.col("step").alias("old"), F.lit(None).cast("long").alias("from_step")).unionByName(new).repartition("seed")
        met = met.groupBy("seed", *node).agg(F.min("old").alias("old"), F.min("from_step").alias("from_step"))
        met = met.withColumn("step", F.row_number().over(by.orderBy(F.asc_nulls_last("old"), "from_step", "id")).cast("long")).withColumn("fresh", F.col("old").isNull())
        met = met.withColumn("stop", F.min(F.when(F.col("fresh") & F.col("data"), F.col("step"))).over(by)).withColumn("moved", F.max("fresh").over(by))
        level = cut(met.where("stop is null or step <= stop").select("seed", *node, "step", "fresh", (F.col("stop").isNotNull() | ~F.col("moved")).alias("over")))
        over.append(level.where("over"))
        going = level.where("not over")
    e.unpersist()
    return reduce(DataFrame.unionByName, [*over, going]).select("seed", "id", "step", "name", "tier")


def _flow(l: str) -> list[F.Column]:  # noqa: E741
    """steps, step_types, entry_point, exit_point, hop_count of a list of names and tiers in order."""
    names = F.transform(l, lambda x: x["name"])
    return [names.alias("steps"), F.transform(l, lambda x: x["tier"]).alias("step_types"), F.get(names, F.lit(0)).alias("entry_point"), F.try_element_at(names, F.lit(-1)).alias("exit_point"), F.size(l).cast("long").alias("hop_count")]


def told(chain: DataFrame) -> DataFrame:
    """seed, steps, step_types, entry_point, exit_point, hop_count of chains (seed, step, name, tier)."""
    return chain.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("step", "name", "tier"))).alias("l")).select("seed", *_flow("l"))


def request_flows(g: Graph, chains: DataFrame | None = None, flows: DataFrame | None = None) -> DataFrame:
    """name, strategy, steps, step_types, entry_point, exit_point, hop_count, confidence of request flows, one a name.

    Strategies in order: from endpoints; from the methods of controllers; SQL lineage of three nodes or more (``chains``, with what
    they tell); flows of three nodes or more (``flows``: flow_name, id, step). Of flows with one name the first strategy's stays, then the least id's.
    """
    ends = g.nodes.where("node_type = 'API_ENDPOINT'").select("id", F.col("name").alias("label"), F.lit(1).alias("strategy"))
    inside = g.edges.where("relation in ('DEFINES', 'CONTAINS')").join(g.nodes.where("node_type = 'CONTROLLER'").select(F.col("id").alias("from_id"), F.col("name").alias("owner")), "from_id").select("to_id", "owner").distinct()
    methods = g.nodes.where("node_type in ('FUNCTION', 'ASYNC_FUNCTION', 'METHOD')").select("id", "name")
    methods = inside.join(methods, F.col("to_id") == F.col("id")).select("id", F.concat("owner", F.lit("."), "name").alias("label"), F.lit(2).alias("strategy"))
    starts = cut(ends.unionByName(methods).distinct())
    traced = told(until_data(g, starts)).where("hop_count >= 2").withColumnRenamed("seed", "id").join(starts, "id")
    found = [traced.withColumn("confidence", F.when(F.col("hop_count") >= 3, "high").otherwise("medium"))]
    if chains is not None:
        label = F.concat(F.lit("SQL lineage to table '"), "table_name", F.lit("' via "), "accessor_name")
        id_ = F.concat_ws("|", "table_id", "accessor", "relation")
        found.append(chains.where(F.size("path") >= 3).select(id_.alias("id"), *_flow("told"), label.alias("label"), F.lit(3).alias("strategy"), "confidence"))
    if flows is not None:
        f = flows.select(F.col("flow_name").alias("seed"), "id", "step").join(g.nodes.select("id", "name", tier().alias("tier")), "id")
        f = told(f).where("hop_count >= 3").withColumnRenamed("seed", "id")
        found.append(f.withColumn("label", F.col("id")).withColumn("strategy", F.lit(4)).withColumn("confidence", F.lit("medium")))
    fields = ["steps", "step_types", "entry_point", "exit_point", "hop_count", "confidence", "strategy"]
    best = reduce(DataFrame.unionByName, found).withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("strategy", "id"))).where("k = 1")
    return best.select(F.col("label").alias("name"), *fields)


# --- libraries ---------------------------------------------------------------------------
# Parts of names that make a method worth showing.
INTERESTING = ["validate", "process", "execute", "build", "create", "run", "parse", "check", "verify", "transform", "generate"]


def library_flows(g: Graph, most: int = 4, enough: int = 6) -> DataFrame:
    """name, steps: for the ``most`` most interesting public methods of classes (equals by class and method id) who calls whom.

    Starting with the method, the next node met is asked for its calls until there are ``enough`` steps; a call adds a step and its
    return. What a node calls goes by (to_id, relation). Each round asks one node a flow, so a round joins ``most`` rows, and a flow goes on
    only while it has fewer than three calls.
    """
    score = sum((F.when(F.contains(F.lower("method"), F.lit(w)), 3).otherwise(0) for w in INTERESTING), F.lit(1))
    classes = g.nodes.where("node_type = 'CLASS'").select(F.col("id").alias("from_id"), F.col("name").alias("class"))
    inside = g.edges.where("relation = 'CONTAINS'").join(classes, "from_id")
    methods = g.nodes.where("node_type in ('METHOD', 'FUNCTION') and not startswith(name, '_')").select(F.col("id").alias("to_id"), F.col("name").alias("method"))
    first = inside.join(methods, "to_id").select("from_id", "to_id", "class", "method", score.alias("score")).distinct().orderBy(F.desc("score"), "from_id", "to_id").limit(most)
    actor = inside.groupBy("to_id").agg(F.min_by("class", "from_id").alias("actor"))
    calls = g.edges.where("relation in ('CALLS', 'CALLS_API')").select("from_id", "to_id", "relation").distinct().join(g.nodes.select(F.col("id").alias("to_id"), "name"), "to_id").join(actor, "to_id", "left")
    calls = calls.groupBy(F.col("from_id").alias("at")).agg(F.array_sort(F.collect_list(F.struct("to_id", "relation", "name", F.coalesce("actor", F.lit("System")).alias("actor")))).alias("calls"))
    say = lambda a, b, what: F.concat(a, F.lit(" → "), b, F.lit(": "), what)
    flow = cut(first.select(
        F.concat("class", F.lit("."), "method", F.lit("()")).alias("name"), "class",
        F.array(F.struct(F.col("to_id").alias("id"), F.col("class").alias("actor"))).alias("queue"), F.array().cast("array<string>").alias("seen"),
        F.array(say(F.lit("Caller"), F.col("class"), F.concat("method", F.lit("(input)")))).alias("steps"),
    ))
    while True:
        todo = flow.withColumn("queue", F.filter("queue", lambda x: ~F.array_contains("seen", x["id"])))
        todo = todo.withColumn("head", F.when(F.size("steps") < enough, F.get("queue", F.lit(0))))
        if todo.where("head is not null").isEmpty():
            break
        met = todo.withColumn("at", F.col("head.id")).join(calls, "at", "left")
        new = F.coalesce("calls", F.array().cast(calls.schema["calls"].dataType))
        said = F.flatten(F.transform(new, lambda c: F.array(say(F.col("head.actor"), c["actor"], F.concat(c["name"], F.lit("()"))), say(c["actor"], F.col("head.actor"), F.lit("return result")))))
        going = F.col("head").isNotNull()
        flow = cut(met.select(
            "name", "class",
            F.when(going, F.concat(F.slice("queue", 2, 1 << 20), F.transform(new, lambda c: F.struct(c["to_id"].alias("id"), c["actor"].alias("actor"))))).otherwise(F.col("queue")).alias("queue"),
            F.when(going, F.concat("seen", F.array("at"))).otherwise(F.col("seen")).alias("seen"),
            F.when(going, F.concat("steps", said)).otherwise(F.col("steps")).alias("steps"),
        ))
    back = F.when(F.exists("steps", lambda x: F.contains(x, F.lit("→ Caller"))), F.col("steps")).otherwise(F.concat("steps", F.array(F.concat("class", F.lit(" → Caller: return result")))))
    return flow.select("name", back.alias("steps"))
