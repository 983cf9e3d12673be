"""Note tables derived from the driver's tables, for queries and their checks.

Each view is one SELECT in SQL that Spark and DuckDB both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# view -> (source table, its id column, select list)
VIEWS = {
    # Labelled notes with padded, lower-case, unknown and missing labels.
    "v_notes": (
        "documents",
        "doc_id",
        [
            "doc_id AS note_id",
            "text AS rep_note",
            """CASE doc_id % 8
                WHEN 0 THEN 'SUPPLY_CHAIN_ISSUE'
                WHEN 1 THEN 'RETAILER_RELATIONSHIP_ISSUE'
                WHEN 2 THEN 'PRICING_AND_MARGIN_CONFLICT'
                WHEN 3 THEN 'COMPETITOR_MARKET_PRESSURE'
                WHEN 4 THEN 'DEMAND_SURGE'
                WHEN 5 THEN ' demand_surge '
                WHEN 6 THEN 'OTHER'
                ELSE NULL END AS issue_category""",
        ],
    ),
    # Shorthand, repeated marks, special characters, blank notes.
    "v_noisy_notes": (
        "orders",
        "o_orderkey",
        [
            "o_orderkey AS note_id",
            """CASE WHEN o_orderkey % 17 = 0 THEN '   '
                ELSE concat('  STK!!! nt cmng frm ', o_orderpriority, '... rt2 #',
                            o_custkey, ',, ot?? supply-chain dlvry ', o_orderstatus, '  ')
                END AS rep_note""",
        ],
    ),
    # Model output for every way of parsing it.
    "v_raw_outputs": (
        "events",
        "event_id",
        [
            "event_id AS note_id",
            """CASE event_id % 11
                WHEN 0 THEN 'supply_chain_delay'
                WHEN 1 THEN 'Category: Pricing_Conflict.'
                WHEN 2 THEN 'The category is demand_spike'
                WHEN 3 THEN 'my guess: competitor_pressure, again'
                WHEN 4 THEN 'retailer dissatisfaction'
                WHEN 5 THEN 'stock shortage delivery delay'
                WHEN 6 THEN 'price demand'
                WHEN 7 THEN 'no list holds these words'
                WHEN 8 THEN 'x'
                WHEN 9 THEN '- category: demand_spike'
                ELSE '' END AS raw_output""",
            """CASE event_id % 5
                WHEN 0 THEN 'supply_chain_delay'
                WHEN 1 THEN 'retailer_dissatisfaction'
                WHEN 2 THEN 'pricing_conflict'
                WHEN 3 THEN 'competitor_pressure'
                ELSE 'demand_spike' END AS true_category""",
            "CASE WHEN event_id % 2 = 0 THEN 'primary' ELSE 'fallback' END AS method",
            "value / 100.0 AS latency_seconds",
        ],
    ),
    # Whole documents between a lead-in and a last word of model output.
    "v_text_outputs": (
        "documents",
        "doc_id",
        [
            "doc_id AS note_id",
            *(
                f"""concat(CASE doc_id % 5
                    WHEN 0 THEN 'Category: '
                    WHEN 1 THEN '- the category is '
                    WHEN 2 THEN '  Output: '
                    ELSE '' END, text, CASE doc_id % 13
                    WHEN 0 THEN ' pricing_conflict.'
                    WHEN 1 THEN ' retailer dissatisfaction'
                    WHEN 2 THEN ' stock shortage delivery delay'
                    WHEN 3 THEN ' price demand'
                    WHEN 4 THEN ' COMPETITOR promotion!?'
                    WHEN 5 THEN chr(10)
                    WHEN 6 THEN ' Demand_Spike, supply_chain_delay'
                    ELSE '' END) AS {name}"""
                for name in ("raw_output", "rep_note")
            ),
        ],
    ),
    # Prediction log with some categories missing.
    "v_log": (
        "events",
        "event_id",
        [
            "event_id AS id",
            "ts",
            "props AS input_note",
            """CASE WHEN event_id % 97 = 0 THEN NULL
                WHEN event_type = 'error' THEN 'supply_chain_delay'
                WHEN event_type = 'click' THEN 'retailer_dissatisfaction'
                WHEN event_type = 'purchase' THEN 'pricing_conflict'
                WHEN event_type = 'view' THEN 'competitor_pressure'
                ELSE 'demand_spike' END AS issue_category""",
        ],
    ),
    # Batches of notes; batch 0 is over the size limit.
    "v_batches": (
        "documents",
        "doc_id",
        [
            "doc_id AS note_id",
            "text AS rep_note",
            """CASE WHEN doc_id < 80 THEN 0
                ELSE CAST(floor(doc_id / 40.0) AS BIGINT) END AS batch_id""",
            "CASE WHEN doc_id < 80 THEN doc_id ELSE doc_id % 40 END AS idx",
        ],
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    source, _, select = VIEWS[name]
    rows = table(spark, sf_dir, source)
    return rows.selectExpr(*select)


def view_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same view on its source table read as a stream of files."""
    source, _, select = VIEWS[name]
    schema = table(spark, sf_dir, source).schema
    # A pattern, since a plain path of a stream must be a folder; the table may
    # be a file or a folder of files.
    path = f"{sf_dir}/{{{source}}}.parquet"
    return spark.readStream.schema(schema).parquet(path).selectExpr(*select)


def view_sql(name: str) -> str:
    """The view as the body of a common table expression."""
    source, _, select = VIEWS[name]
    return f"{name} AS (SELECT {', '.join(select)} FROM {source})"
