"""Views of the driver's tables in the roles of the ledger: Spark DataFrames here, the same as SQL in ROLES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BRACKET = ["region", "queue", "tier", "division"]
#: Fixed values of the tables: part types, customer segments, event kinds.
TYPES = ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
KINDS = ["view", "click", "purchase", "signup", "error"]
DIVISIONS = ["I", "II", "III", "IV"]
TASKS_AS_OF = "2001-08-01 00:00:00"


class Roles:
    """Lazy role views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, name: str) -> DataFrame:
        """A table whose rows take much work each, dealt over all cores: its file may be one split, whatever the number of its rows."""
        return self.table(name).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def tasks(self, *priorities: str) -> DataFrame:
        orders = self.table("orders")
        if priorities:
            orders = orders.where(F.col("o_orderpriority").isin(*priorities))
        status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "success").otherwise("in_progress")
        return orders.select(
            F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 50).alias("run_id"), F.col("o_custkey").alias("entity_id"), status.alias("status"), F.col("o_orderdate").alias("ts"),
            F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("error_message"), F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("/t/"), F.col("o_orderkey"))).alias("file_path"),
        )

    def snapshot_tasks(self) -> DataFrame:
        return self.tasks("1-URGENT")

    def detail_tasks(self) -> DataFrame:
        return self.tasks("2-HIGH")

    def task_rows(self, tasks: DataFrame) -> DataFrame:
        return tasks.select("task_id", "run_id", "entity_id", "status", "file_path", "error_message", F.col("ts").alias("finished_at"))

    def task_events(self) -> DataFrame:
        """Every task goes in progress a day before its end; a third of them twice."""
        t = self.tasks()
        steps = F.array(
            F.struct(F.lit(0).alias("seq"), F.lit("pending").alias("status"), F.expr("ts - INTERVAL 3 DAY").alias("at")), F.struct(F.lit(1).alias("seq"), F.lit("in_progress").alias("status"), F.expr("ts - INTERVAL 2 DAY").alias("at")),
            F.struct(F.lit(2).alias("seq"), F.when(F.col("task_id") % 3 == 0, F.lit("in_progress")).alias("status"), F.expr("ts - INTERVAL 1 DAY").alias("at")), F.struct(F.lit(3).alias("seq"), F.when(F.col("status") != "in_progress", F.col("status")).alias("status"), F.col("ts").alias("at")),
        )
        rows = t.select("task_id", "run_id", "entity_id", "file_path", "error_message", F.explode(steps).alias("s")).where("s.status is not null")
        return rows.select(
            "task_id", "run_id", "entity_id", F.col("s.at").alias("ts"), F.col("s.seq").cast("long").alias("seq"), F.col("s.status").alias("status"), F.when(F.col("s.seq") == 3, F.col("file_path")).alias("file_path"),
            F.when(F.col("s.seq") == 3, F.col("error_message")).alias("error"), F.concat(F.lit("p"), F.year("s.at")).alias("patch"),
        )

    def run_events(self) -> DataFrame:
        """A start per run, a heartbeat per task, and for every fifth run a finish."""
        t = self.tasks()
        beat = t.select("run_id", "ts", F.col("task_id").alias("seq"), F.lit("heartbeat").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("error"))
        ends = t.groupBy("run_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        start = ends.select("run_id", F.col("first").alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit("start").alias("kind"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"))
        finish = ends.where("run_id % 5 = 0").select("run_id", F.expr("last + INTERVAL 1 DAY").alias("ts"), F.lit(2**40).alias("seq"), F.lit("finish").alias("kind"), F.when(F.col("run_id") % 2 == 0, "success").otherwise("failed").alias("status"), F.when(F.col("run_id") % 2 == 1, "stopped").alias("error"))
        return beat.unionByName(start).unionByName(finish)

    def runs(self) -> DataFrame:
        t = self.tasks().groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_heartbeat"))
        return t.select("*", F.lit("running").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("timestamp_ntz").alias("finished_at"))

    def brackets(self) -> DataFrame:
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("entity_id"), F.col("r_name").alias("region"), F.lit("RANKED").alias("queue"), F.col("c_mktsegment").alias("tier"), F.get(F.array(*map(F.lit, DIVISIONS)), (F.col("c_custkey") % 4).cast("int")).alias("division")
        )

    def records(self) -> DataFrame:
        """Entities with snapshot tasks: these are the history; the last detail task is theirs."""
        entry = F.struct("ts", "task_id", "file_path")
        history = self.snapshot_tasks().groupBy("entity_id").agg(F.array_sort(F.collect_list(entry)).alias("h"), F.max("ts").alias("latest_logged_at"))
        as_entry = lambda e: F.struct(e["task_id"].alias("task_id"), e["file_path"].alias("path"), e["ts"].alias("logged_at"), F.concat(F.lit("p"), F.year(e["ts"])).alias("patch"))
        history = history.select("entity_id", F.transform("h", as_entry).alias("history"), "latest_logged_at")
        last = self.detail_tasks().groupBy("entity_id").agg(F.max_by(F.struct("task_id", "status", "file_path", "ts"), F.struct("ts", "task_id")).alias("d"))
        rows = history.join(last, "entity_id", "left").join(self.brackets(), "entity_id", "left")
        return rows.select(
            "entity_id", *BRACKET, "history", "latest_logged_at", F.col("d.task_id").alias("detail_task_id"), F.coalesce("d.status", F.lit("pending")).alias("detail_status"), F.col("d.file_path").alias("detail_path"),
            F.col("d.ts").alias("detail_logged_at"), F.concat(F.lit("p"), F.year("d.ts")).alias("detail_patch"),
        )

    def sightings(self) -> DataFrame:
        day = F.dayofmonth("ts")
        kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")) - 1
        rows = self.table("events").select(
            F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), F.col("ts").alias("logged_at"), F.col("event_type").alias("tier"), F.get(F.array(*map(F.lit, DIVISIONS)), (F.col("user_id") % 4).cast("int")).alias("division"),
            F.concat(F.lit("24."), F.ceil(day / 7)).alias("patch"), (day * 5 + kind).cast("long").alias("task_id"),
        )
        return rows.join(self.brackets().select("entity_id", "region", "queue"), "entity_id").withColumn("path", F.concat(F.lit("/p/"), F.col("task_id")))

    def raw_details(self, item: str = "p_type") -> DataFrame:
        lines = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return lines.select(F.col("o_custkey").alias("entity_id"), F.expr(item).alias("item_name"), F.col("l_quantity").cast("long").alias("points"), F.col("l_shipdate").alias("last_played"))

    def details(self, item: str = "p_type") -> DataFrame:
        return self.raw_details(item).groupBy("entity_id", "item_name").agg(F.sum("points").alias("points"), F.max("last_played").alias("last_played"))

    def items(self) -> DataFrame:
        """Part types by number, one left out: its details have no name."""
        rows = [(str(n), t) for n, t in enumerate(TYPES) if t != "LARGE"]
        return self.spark.createDataFrame(rows, "item_id string, item_name string")

    def numbered_details(self) -> DataFrame:
        number = F.array_position(F.array(*map(F.lit, TYPES)), F.col("item_name")) - 1
        return self.details().select("entity_id", number.alias("item_id"), "points", "last_played")

    def entities(self) -> DataFrame:
        return self.table("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tier"))

    def page_observations(self) -> DataFrame:
        return self.table("events").groupBy(F.col("event_type").alias("tier"), F.dayofmonth("ts").cast("long").alias("seq")).agg(F.count("*").alias("player_count"))

    def conversation_docs(self) -> DataFrame:
        """A nested document per conversation, as the variant column doc."""
        turns = self.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        return turns.select(F.concat(F.lit("/c/"), F.col("conv_id")).alias("path"), F.try_parse_json(F.to_json(F.struct("conv_id", "turns"))).alias("doc"))

    def entry_rows(self) -> DataFrame:
        """A snapshot entry per customer as JSON text; in every third page of 25 some fields are missing, null or of another kind."""
        odd = "c_custkey div 25 % 3 = 0"
        fields = [
            f"""'"queueType": ' || if({odd} and c_custkey % 11 = 3, '7', '"RANKED"')""",
            f"""'"tier": ' || if({odd} and c_custkey % 13 = 5, 'null', '"' || c_mktsegment || '"')""",
            f"""if({odd} and c_custkey % 17 = 2, null, '"rank": "I"')""",
            """'"puuid": "' || c_name || '"'""",
            f"""'"leaguePoints": ' || if({odd}, cast(floor(c_acctbal) as string), cast(floor(abs(c_acctbal)) as string) || '.0')""",
            f"""'"wins": ' || case when c_custkey % 6 = 0 then '"12"' when c_custkey % 6 = 1 then '12.0' when c_custkey % 6 = 2 then 'true' when {odd} and c_custkey % 6 = 3 then '12.5' when {odd} and c_custkey % 6 = 4 then '"x"' else cast(c_custkey as string) end""",
            """'"losses": ' || c_nationkey""",
            f"""'"veteran": ' || case c_custkey % 5 when 0 then 'true' when 1 then '"yes"' when 2 then '0' when 3 then if({odd}, '"maybe"', '"on"') else 'false' end""",
            """'"inactive": false'""",
            """'"freshBlood": 1'""",
            f"""'"hotStreak": ' || if({odd} and c_custkey % 19 = 0, 'null', '"off"')""",
            """'"extra": {"a": 1}'""",
        ]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *map(F.expr, fields)), F.lit("}"))
        return self.dealt("customer").select(F.col("c_custkey").alias("entity_id"), F.expr("c_custkey div 25").alias("page"), text.alias("entry"))

    def detail_rows(self) -> DataFrame:
        """A detail of each entity and item as JSON text, some of them invalid."""
        fields = [
            """'"puuid": "' || entity_id || '"'""",
            """'"championId": ' || item_id""",
            """'"championLevel": "' || points % 4 || '"'""",
            """'"championPoints": ' || points""",
            """'"lastPlayTime": ' || item_id * 1000""",
            """'"championPointsSinceLastLevel": -5'""",
            """if(entity_id % 7 = 0, null, '"championPointsUntilNextLevel": 10')""",
            """case item_id when 1 then '"milestoneGrades": ["A", "S-"]' when 2 then '"milestoneGrades": null' when 3 then '"milestoneGrades": "A"' when 4 then '"milestoneGrades": []' end""",
        ]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *map(F.expr, fields)), F.lit("}"))
        return self.numbered_details().select("entity_id", "item_id", text.alias("detail"))

    def file_docs(self) -> tuple[DataFrame, DataFrame]:
        """(path, value) of snapshot pages, 64 order keys each, and of detail files, one per entity and year; some of them faulty."""
        page = F.expr("task_id div 64")
        person = lambda c: F.concat(F.lit('{"puuid": "'), c, F.lit('"}'))
        seen = F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.struct("task_id", "entity_id")))), lambda e: person(e["entity_id"]))
        listed = lambda entries: F.concat(F.lit('{"players": ['), F.array_join(entries, ", "), F.lit("]}"))
        kind = F.col("page") % 10
        broken_off = F.concat(F.slice("seen", 1, 2), F.array(F.lit("5")), F.slice("seen", F.lit(3), F.greatest(F.size("seen") - 2, F.lit(0))))
        value = (
            F.when(kind == 3, listed(broken_off)).when(kind == 5, '{"players": []}').when(kind == 6, '{"pages": 1}').when(kind == 7, '{"players": "none"}')
            .when(kind == 8, '[{"puuid": "1"}]').when(kind == 9, "{no json").otherwise(listed(F.col("seen")))
        )
        pages = self.tasks().groupBy(page.alias("page")).agg(seen.alias("seen")).select(F.concat(F.lit("/s/"), "page").alias("path"), value.alias("value"))
        files = self.snapshot_tasks().where("status = 'success'").select("entity_id", F.year("ts").alias("year")).distinct()
        own = F.when(F.col("entity_id") % 9 == 0, F.lit("")).otherwise(F.concat(person(F.col("entity_id")), F.lit(', {"puuid": "other"}')))
        return pages, files.select(F.concat_ws("/", F.lit("/d"), "entity_id", "year").alias("path"), F.concat(F.lit('{"masteries": ['), own, F.lit("]}")).alias("value"))


ROLES = """
WITH tasks AS (
  SELECT o_orderkey AS task_id, o_orderkey % 50 AS run_id, o_custkey AS entity_id, o_orderpriority AS priority, o_orderdate AS ts,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'in_progress' END AS status,
         CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS error_message, CASE WHEN o_orderstatus = 'O' THEN '/t/' || o_orderkey END AS file_path
  FROM orders),
snapshot_tasks AS (SELECT * FROM tasks WHERE priority = '1-URGENT'),
detail_tasks AS (SELECT * FROM tasks WHERE priority = '2-HIGH'),
runs AS (SELECT run_id, min(ts) AS started_at, max(ts) AS last_heartbeat FROM tasks GROUP BY run_id),
steps AS (
  SELECT task_id, run_id, entity_id, ts - INTERVAL 3 DAY AS ts, 0 AS seq, 'pending' AS status, NULL AS file_path, NULL AS error FROM tasks
  UNION ALL SELECT task_id, run_id, entity_id, ts - INTERVAL 2 DAY, 1, 'in_progress', NULL, NULL FROM tasks
  UNION ALL SELECT task_id, run_id, entity_id, ts - INTERVAL 1 DAY, 2, 'in_progress', NULL, NULL FROM tasks WHERE task_id % 3 = 0
  UNION ALL SELECT task_id, run_id, entity_id, ts, 3, status, file_path, error_message FROM tasks WHERE status <> 'in_progress'),
brackets AS (
  SELECT c_custkey AS entity_id, r_name AS region, 'RANKED' AS queue, c_mktsegment AS tier, ['I', 'II', 'III', 'IV'][c_custkey % 4 + 1] AS division
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
history AS (SELECT entity_id, list(task_id ORDER BY ts, task_id) AS h, max(ts) AS latest_logged_at FROM snapshot_tasks GROUP BY entity_id),
last_detail AS (SELECT * FROM detail_tasks QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, task_id DESC) = 1),
records AS (
  SELECT h.entity_id, region, queue, tier, division, h, latest_logged_at, d.task_id AS detail_task_id, coalesce(d.status, 'pending') AS detail_status,
         d.file_path AS detail_path, d.ts AS detail_logged_at, 'p' || year(d.ts) AS detail_patch
  FROM history h LEFT JOIN last_detail d ON h.entity_id = d.entity_id LEFT JOIN brackets b ON h.entity_id = b.entity_id),
sightings AS (
  SELECT user_id AS entity_id, event_id AS seq, ts AS logged_at, event_type AS tier, ['I', 'II', 'III', 'IV'][user_id % 4 + 1] AS division, b.region, b.queue,
         '24.' || CAST(ceil(day(ts) / 7.0) AS INTEGER) AS patch, day(ts) * 5 + list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type) - 1 AS task_id
  FROM events JOIN brackets b ON user_id = b.entity_id),
raw_details AS (
  SELECT o_custkey AS entity_id, p_type AS item_name, CAST(l_quantity AS BIGINT) AS points, l_shipdate AS last_played
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
details AS (SELECT entity_id, item_name, CAST(sum(points) AS BIGINT) AS points, max(last_played) AS last_played FROM raw_details GROUP BY 1, 2),
numbered AS (SELECT entity_id, list_position(['STANDARD', 'ECONOMY', 'MEDIUM', 'PROMO', 'LARGE', 'SMALL'], item_name) - 1 AS item_id, item_name AS true_name, points, last_played FROM details),
entities AS (SELECT c_custkey AS entity_id, c_name AS name, c_mktsegment AS tier FROM customer WHERE c_acctbal >= 0),
pages_seen AS (SELECT event_type AS tier, day(ts) AS seq, count(*) AS player_count FROM events GROUP BY 1, 2)
"""
