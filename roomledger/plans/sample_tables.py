"""Bookings, questions and request logs derived from the test tables.

Missing values, impossible dates and copies come from fixed rules on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.sources.splits import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wide_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows carry most of the work, spread over all cores."""
    return spread(table(spark, folder, name))


def bookings(spark: SparkSession, folder: str) -> DataFrame:
    """One booking per line item, and a copy of those with line number 1.

    Customers meet the orders first, as there are fewer orders than items to move.
    """
    items = wide_table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    ordered = orders.join(
        customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey")
    )
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.selectExpr(
        "case when l_linestatus = 'F' then 'City Hotel' else 'Resort Hotel' end as hotel",
        "case when l_returnflag = 'R' then 1 else 0 end as is_canceled",
        "pmod(datediff(l_shipdate, o_orderdate), 400) as lead_time",
        "year(l_shipdate) as arrival_date_year",
        "date_format(l_shipdate, 'MMMM') as arrival_date_month",
        "case when l_linenumber = 7 then 31 else day(l_shipdate) end as arrival_date_day_of_month",
        "l_linenumber % 3 as stays_in_weekend_nights",
        "cast(l_quantity as int) % 8 as stays_in_week_nights",
        "cast(case when l_partkey % 11 = 0 then null else l_partkey % 4 end as double) as children",
        "cast(case when l_suppkey % 10 = 0 then null else l_suppkey end as double) as agent",
        "cast(case when c_custkey % 20 = 0 then c_custkey end as double) as company",
        "case when n_name = 'NATION_7' then null else n_name end as country",
        "c_mktsegment as market_segment",
        "p_type as reserved_room_type",
        "o_orderpriority as customer_type",
        "cast(l_extendedprice as decimal(18,2)) as adr",
        "cast(cast(o_orderdate as date) as string) as reservation_status_date",
        "l_orderkey",
        "l_linenumber",
        "explode(sequence(1, case when l_linenumber = 1 then 2 else 1 end)) as copy",
    ).drop("copy")


# The sample questions (fixed values).
SAMPLE_QUESTIONS = (
    "Show me total revenue for July 2017.",
    "Which locations had the highest booking cancellations?",
    "What is the average price of a hotel booking?",
    "What is the cancellation rate for city hotels?",
    "Which market segment has the highest booking percentage?",
    "Which market segment has the highest cancellation rate?",
    "What are the trends in monthly revenue?",
    "How does the lead time affect cancellation rates?",
    "Which customer type generates the highest revenue?",
    "What's the average length of stay at resort hotels?",
)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per user turn, and the following assistant turn as the model's raw answer.

    A sample question follows the user's text; amounts and names that formatting looks for follow
    the assistant's. A turn without a reply has no raw answer.
    """
    turns = table(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id",
        "turn",
        F.concat_ws("-", "conv_id", "turn").alias("question_id"),
        F.concat(
            "text",
            F.lit(" "),
            F.element_at(F.lit(list(SAMPLE_QUESTIONS)), ((F.col("conv_id") + F.col("turn")) % 10 + 1).cast("int")),
        ).alias("question"),
    )
    replies = turns.where("role = 'assistant'").selectExpr(
        "conv_id",
        "turn - 1 as turn",
        "concat(text, ' $ ', turn, '.5 and ', turn, ' % at City Hotel via Direct') as raw_answer",
    )
    return asked.join(replies, ["conv_id", "turn"], "left").select("question_id", "question", "raw_answer")


def chart_files(spark: SparkSession, folder: str) -> DataFrame:
    """One file per web page: the page's bytes under a chart name and, but for .html URLs, as PNG."""
    return wide_table(spark, folder, "pages").selectExpr(
        """concat('charts/', page_id, '/', case page_id % 6
               when 0 then 'monthly_revenue' when 1 then 'cancellation_by_hotel' when 2 then 'top_countries'
               when 3 then 'lead_time_distribution' when 4 then 'adr_by_customer'
               else concat('page_', page_id) end,
               case when page_id % 7 = 0 then '.v2' else '' end,
               case when url like '%.html' then '.html' else '.png' end) as path""",
        "encode(html, 'utf-8') as content",
    )


def vector_questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr("vec_id as question_id", "embedding")


def vector_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored vector as a document; label 0 stands for charts."""
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id as doc_id",
        "concat('vector ', vec_id, ' of class ', label) as page_content",
        """case when label = 0
               then map('type', 'graph', 'image_base64', base64(encode(cast(vec_id as string), 'utf-8')),
                        'description', concat('chart ', vec_id))
               else map('category', concat('class ', label)) end as metadata""",
        "embedding",
    )


def answer_log(spark: SparkSession, folder: str) -> DataFrame:
    """A request for each user turn that has an event of its number; it takes as long as the event's value says."""
    turns = table(spark, folder, "conversations").where("role = 'user'")
    asked = turns.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), (F.col("conv_id") * 10 + F.col("turn") + 1).alias("question_number"))
    return asked.join(request_log(spark, folder), "question_number").select("question_id", "started_at", "ended_at")


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """One request per event, which takes as many seconds as the event's value says."""
    return table(spark, folder, "events").selectExpr(
        "event_id + 1 as question_number",
        "props as question",
        """concat('Seen: ', event_type, case when event_id % 3 = 0
               then concat(' (Response time: ', format_number(value, '0.00'), ' seconds)') else '' end) as answer""",
        "case event_type when 'view' then base64(encode(props, 'utf-8')) when 'click' then '' end as graph",
        "ts as started_at",
        "timestamp_micros(unix_micros(cast(ts as timestamp)) + cast(round(value * 1000000) as bigint)) as ended_at",
    )
