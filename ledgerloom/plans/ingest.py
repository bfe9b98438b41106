"""Queries on sources, harmonising, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import harmonise as H
from ledgerloom.operators.numbering import numbered
from ledgerloom.plans.views import R, T, X, candidates, rankings, tasks
from ledgerloom.sources.durable import scratch_path
from ledgerloom.sources.files import read_json_lines, update_by_key, write_json_lines
from ledgerloom.sources.tables import table

def _register():
    """A module's registries and the decorator that fills them: ``@query(sql)``; without SQL a query is tested on fixtures."""
    queries, sqls = {}, {}

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return register

    return queries, sqls, query


QUERIES, SQL, query = _register()


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value, json_extract_string(props, '$.k')::BIGINT k FROM events")
def scan_events_json(spark, d):
    """Written as JSON lines and read back under a schema, the nested text taken apart."""
    path = scratch_path(spark, "events")
    write_json_lines(table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props"), path)
    rows = read_json_lines(spark, path, "event_id bigint, user_id bigint, event_type string, value double, props string")
    return rows.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT index::BIGINT task_no, source, user_id, target_item_id target, len(candidate_item_ids)::BIGINT n FROM task_profile")
def sink_roundtrip(spark, d):
    path = scratch_path(spark, "tasks")
    rows = table(spark, d, "task_profile").select(F.col("index").cast("bigint").alias("task_no"), "source", "user_id", F.col("target_item_id").alias("target"), F.col("candidate_item_ids").alias("candidates"))
    write_json_lines(rows, path)
    return read_json_lines(spark, path, "task_no bigint, source string, user_id string, target string, candidates array<string>").select("task_no", "source", "user_id", "target", F.size("candidates").cast("bigint").alias("n"))


@query("SELECT item_id, name, city FROM (SELECT DISTINCT item_id, name, city FROM item WHERE source = 'yelp') ORDER BY item_id, name, city LIMIT 500")
def scan_filter_limit(spark, d):
    """The first 500 items of a source; the limit is the operator."""
    return table(spark, d, "item").where("source = 'yelp'").select("item_id", "name", "city").distinct().orderBy(F.asc_nulls_last("item_id"), F.asc_nulls_last("name"), F.asc_nulls_last("city")).limit(500)


@query("SELECT item_id FROM item WHERE source = 'amazon' AND item_id <> ''")
def catalog_ids(spark, d):
    return table(spark, d, "item").where("source = 'amazon' AND item_id <> ''").select("item_id")


_TASKS_SQL = "SELECT t.index::BIGINT task_no, user_id, target_item_id target, list_contains(candidate_item_ids, target_item_id) AS offered FROM (SELECT DISTINCT index, user_id, target_item_id, candidate_item_ids FROM task_profile) t"


@query(_TASKS_SQL)
def task_load(spark, d):
    """Tasks with their number taken from the file's name."""
    rows = table(spark, d, "task_profile").select(F.regexp_extract("task_file", r"(\d+)\.json$", 1).cast("bigint").alias("task_no"), "user_id", F.col("target_item_id").alias("target"), F.col("candidate_item_ids").alias("c")).distinct()
    return rows.select("task_no", "user_id", "target", F.array_contains("c", F.col("target")).alias("offered"))


@query(f"WITH {T} SELECT t.\"index\" task_no, t.user_id, e.stars, length(e.review)::BIGINT chars FROM t JOIN (SELECT row_number() OVER (ORDER BY eval_id) - 1 AS number, stars, review FROM eval_item) e ON e.number = t.\"index\"")
def task_load_by_number(spark, d):
    """Tasks joined with their ground truth by number; those without are left out."""
    told = numbered(table(spark, d, "eval_item").withColumn("all", F.lit(0)), ["all"], ["eval_id"], "number")
    truth = told.select((F.col("number") - 1).alias("index"), "stars", F.length("review").cast("bigint").alias("chars"))
    return tasks(spark, d).join(truth, "index").select(F.col("index").alias("task_no"), "user_id", "stars", "chars")


@query(f"WITH {T} SELECT \"index\", target FROM t WHERE list_contains(candidates, target)")
def task_gt_in_candidates(spark, d):
    return tasks(spark, d).where(F.array_contains("candidates", F.col("target"))).select("index", "target")


@query(f"WITH {T} SELECT DISTINCT user_id, target FROM t WHERE list_contains(candidates, target)")
def exclusion_pairs(spark, d):
    return tasks(spark, d).where(F.array_contains("candidates", F.col("target"))).select("user_id", "target").distinct()


@query("SELECT review_id, seq, stars FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY seq DESC) rn FROM review WHERE review_id IS NOT NULL) WHERE rn = 1")
def last_wins_dedup(spark, d):
    return H.last_wins(table(spark, d, "review").where("review_id IS NOT NULL").select("review_id", "seq", "stars"), "review_id", "seq")


@query(f"WITH {X}, m AS (SELECT \"index\", item_id, pos AS new_pos FROM x WHERE item_id = target) SELECT x.\"index\", x.item_id, coalesce(m.new_pos, -1)::BIGINT found_at FROM x LEFT JOIN m ON m.\"index\" = x.\"index\" AND m.item_id = x.item_id")
def update_by_key_(spark, d):
    """Rows keep their place, some get a new value by key."""
    rows = candidates(spark, d)
    base = rows.select("index", "item_id", F.lit(-1).cast("bigint").alias("found_at"))
    changes = rows.where("item_id = target").select("index", "item_id", F.col("pos").cast("bigint").alias("found_at"))
    return update_by_key(base, changes, ["index", "item_id"])


QUERIES["update_by_key"], SQL["update_by_key"] = QUERIES.pop("update_by_key_"), SQL.pop("update_by_key_")

_ITEMS = """SELECT s_suppkey::VARCHAR item_id, 'yelp' AS source, 'business' AS type, s_name AS name, NULL AS title FROM supplier
UNION ALL SELECT p_partkey::VARCHAR, 'amazon', 'product', NULL, p_name FROM part UNION ALL SELECT c_custkey::VARCHAR, 'goodreads', 'book', NULL, c_name FROM customer"""


def _items(spark, d):
    business = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("business_id"), F.col("s_name").alias("name"))
    product = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("parent_asin"), F.col("p_name").alias("title"))
    book = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("book_id"), F.col("c_name").alias("title"))
    return H.stacked([H.renamed(business, {"business_id": "item_id"}, "yelp", "business"), H.renamed(product, {"parent_asin": "item_id"}, "amazon", "product"), H.renamed(book, {"book_id": "item_id"}, "goodreads", "book")])


@query(_ITEMS)
def harmonise_items(spark, d):
    return _items(spark, d).select("item_id", "source", "type", "name", "title")


@query(f"SELECT source, type, count(*)::BIGINT n, count(name)::BIGINT names, count(title)::BIGINT titles FROM ({_ITEMS}) GROUP BY 1, 2")
def harmonise_union_all(spark, d):
    return _items(spark, d).groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("names"), F.count("title").alias("titles"))


@query("""SELECT o_custkey user_id, o_orderkey item_id, CASE o_orderstatus WHEN 'F' THEN 'yelp' WHEN 'O' THEN 'amazon' ELSE 'goodreads' END AS source,
  CASE o_orderstatus WHEN 'F' THEN 'business' WHEN 'O' THEN 'product' ELSE 'book' END AS type, o_totalprice stars, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS text, CASE WHEN o_orderstatus = 'O' THEN o_orderkey END sub_item_id FROM orders""")
def harmonise_reviews(spark, d):
    """Three shapes of reviews: each source has other names for the same columns."""
    o = table(spark, d, "orders")
    yelp = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("business_id"), F.col("o_totalprice").alias("stars"))
    amazon = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("parent_asin"), F.col("o_orderkey").alias("asin"), F.col("o_totalprice").alias("rating"))
    books = o.where("o_orderstatus NOT IN ('F', 'O')").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("book_id"), F.col("o_totalprice").alias("rating"), F.col("o_orderpriority").alias("review_text"))
    parts = [
        H.renamed(yelp, {"business_id": "item_id"}, "yelp", "business"),
        H.renamed(amazon, {"parent_asin": "item_id", "asin": "sub_item_id", "rating": "stars"}, "amazon", "product"),
        H.renamed(books, {"book_id": "item_id", "rating": "stars", "review_text": "text"}, "goodreads", "book"),
    ]
    return H.stacked(parts).select("user_id", "item_id", "source", "type", "stars", "text", "sub_item_id")


@query("SELECT source, user_id, count(*)::BIGINT rows, count(DISTINCT (seq, item_id))::BIGINT keys FROM review WHERE user_id IS NOT NULL GROUP BY 1, 2")
def surrogate_keys(spark, d):
    """Content keys: as many as there are different rows."""
    rows = table(spark, d, "review").where("user_id IS NOT NULL").select("source", "user_id", H.surrogate_key(["seq", "item_id"]).alias("key"))
    return rows.groupBy("source", "user_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("keys"))


_FIELDS = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in H.ITEM_FIELDS)


@query(f"SELECT item_id, concat_ws(',', {_FIELDS}) AS fields FROM item")
def item_fields(spark, d):
    """Which of the known columns a row has."""
    present = F.concat_ws(",", *(F.when(F.col(c).isNotNull(), F.lit(c)) for c in H.ITEM_FIELDS))
    return table(spark, d, "item").select("item_id", present.alias("fields"))


@query("SELECT item_id, coalesce(nullif(title, ''), nullif(name, ''), item_id) display FROM item")
def display_name(spark, d):
    return table(spark, d, "item").select("item_id", H.first_filled("title", "name", "item_id").alias("display"))


_TEXT = " ".join(f"WHEN source = '{s}' THEN concat_ws(' ', " + ", ".join(f"nullif(trim({c}), '')" for c in names) + ")" for s, names in H.TEXT_FIELDS.items())


@query(f"SELECT item_id, source, coalesce(nullif(CASE {_TEXT} ELSE concat_ws(' ', nullif(trim(title), ''), nullif(trim(description), '')) END, ''), item_id) AS text FROM item")
def item_text(spark, d):
    return table(spark, d, "item").select("item_id", "source", H.item_text().alias("text"))


@query("SELECT item_id, name, city FROM item WHERE city IN ('Brackenford', 'Dunhallow', 'Gruntal')")
def filter_in_list(spark, d):
    return table(spark, d, "item").where(F.col("city").isin("Brackenford", "Dunhallow", "Gruntal")).select("item_id", "name", "city")


@query("""SELECT user_id, source FROM users u WHERE EXISTS (SELECT 1 FROM review r WHERE r.user_id = u.user_id AND EXISTS (
  SELECT 1 FROM item i WHERE i.item_id = r.item_id AND city IN ('Brackenford', 'Dunhallow', 'Gruntal')))""")
def semi_join_chain(spark, d):
    """Items of some cities, their reviews, those reviews' users."""
    items = table(spark, d, "item").where(F.col("city").isin("Brackenford", "Dunhallow", "Gruntal")).select("item_id")
    reviews = H.keep_known(table(spark, d, "review").select("user_id", "item_id"), item_id=items)
    return H.keep_known(table(spark, d, "users").select("user_id", "source"), user_id=reviews.select("user_id"))


@query("""SELECT seq, user_id, item_id FROM review r WHERE EXISTS (SELECT 1 FROM users u WHERE u.user_id = r.user_id AND u.source = 'amazon')
  AND EXISTS (SELECT 1 FROM item i WHERE i.item_id = r.item_id AND i.average_rating >= 3)""")
def double_semi_join(spark, d):
    users = table(spark, d, "users").where("source = 'amazon'").select("user_id")
    items = table(spark, d, "item").where("average_rating >= 3").select("item_id")
    return H.keep_known(table(spark, d, "review").select("seq", "user_id", "item_id"), user_id=users, item_id=items)


@query("SELECT seq, user_id, item_id FROM review r WHERE NOT EXISTS (SELECT 1 FROM task_profile t WHERE t.user_id = r.user_id AND t.target_item_id = r.item_id)")
def anti_join_blockset(spark, d):
    """Reviews that give no task's answer away."""
    blocked = table(spark, d, "task_profile").select("user_id", F.col("target_item_id").alias("item_id")).distinct()
    return table(spark, d, "review").select("seq", "user_id", "item_id").join(blocked, ["user_id", "item_id"], "left_anti").select("seq", "user_id", "item_id")


@query(f"WITH {T}, h AS (SELECT user_id, count(*) n, max(seq) last_seq FROM review GROUP BY 1) SELECT \"index\", coalesce(n, 0)::BIGINT reviews, last_seq FROM t LEFT JOIN h USING (user_id)")
def user_history(spark, d):
    """Per task what there is of its user; one aggregate per user, so that a busy user's rows are not repeated for each task."""
    history = table(spark, d, "review").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))
    return tasks(spark, d).join(history, "user_id", "left").select("index", F.coalesce("n", F.lit(0)).alias("reviews"), "last_seq")


@query("SELECT DISTINCT user_id FROM review WHERE source = 'amazon'")
def distinct_users(spark, d):
    return table(spark, d, "review").where("source = 'amazon'").select("user_id").distinct()


@query(f"WITH {T} SELECT 'user' AS kind, user_id id FROM t UNION SELECT 'item', target FROM t UNION SELECT 'item', unnest(candidates) FROM t")
def relevant_ids(spark, d):
    """Users and items that some task needs."""
    t = tasks(spark, d)
    ids = [t.select(F.lit("user").alias("kind"), F.col("user_id").alias("id")), t.select(F.lit("item"), "target"), t.select(F.lit("item"), F.explode("candidates"))]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


@query(f"""WITH {X}, {R("hm")} SELECT "index", CASE WHEN error IS NOT NULL THEN error WHEN output IS NULL THEN 'missing output' END AS error, output[1] AS first, coalesce(len(output), 0)::BIGINT n FROM r""")
def prediction_records(spark, d):
    """A record per task: its output, or why there is none."""
    r = rankings(spark, d, "hm")
    error = F.coalesce("error", F.when(F.col("output").isNull(), F.lit("missing output")))
    return r.select("index", error.alias("error"), F.get("output", F.lit(0)).alias("first"), F.coalesce(F.when(F.col("output").isNotNull(), F.size("output")), F.lit(0)).cast("bigint").alias("n"))


_FILLED = " + ".join(f"CASE WHEN {c} IS NOT NULL AND {c} NOT IN ('', '[]', '{{}}') THEN 1 ELSE 0 END" if c not in ("stars", "average_rating", "review_count", "rating_number") else f"CASE WHEN {c} <> 0 THEN 1 ELSE 0 END" for c in H.ITEM_FIELDS)


@query(f"""WITH {X}, f AS (SELECT item_id, max({_FILLED}) filled FROM item GROUP BY 1)
SELECT "index", round(sum(coalesce(filled, 0)) / 12.0 / count(*), 6)::DOUBLE richness FROM x LEFT JOIN f USING (item_id) WHERE pos < 20 GROUP BY 1""")
def metadata_richness(spark, d):
    """Mean share of filled columns over a task's first 20 candidates; an unlisted one has none."""
    items = table(spark, d, "item")
    filled = items.groupBy("item_id").agg(F.max(H.filled_count(H.ITEM_FIELDS, dict(items.dtypes))).alias("filled"))
    rows = candidates(spark, d).where("pos < 20").join(filled, "item_id", "left")
    return rows.groupBy("index").agg(F.round(F.sum(F.coalesce("filled", F.lit(0))) / F.lit(12.0) / F.count(F.lit(1)), 6).alias("richness"))
