"""Table layouts and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

BOOKINGS = T.StructType(
    [
        T.StructField("hotel", T.StringType()),
        T.StructField("is_canceled", T.IntegerType()),
        T.StructField("lead_time", T.IntegerType()),
        T.StructField("arrival_date_year", T.IntegerType()),
        T.StructField("arrival_date_month", T.StringType()),
        T.StructField("arrival_date_day_of_month", T.IntegerType()),
        T.StructField("stays_in_weekend_nights", T.IntegerType()),
        T.StructField("stays_in_week_nights", T.IntegerType()),
        T.StructField("children", T.DoubleType()),
        T.StructField("agent", T.DoubleType()),
        T.StructField("company", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("market_segment", T.StringType()),
        T.StructField("reserved_room_type", T.StringType()),
        T.StructField("customer_type", T.StringType()),
        T.StructField("adr", T.DoubleType()),
        T.StructField("reservation_status_date", T.StringType()),
    ]
)

INSIGHTS = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("subkey", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("page_content", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("subkey", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("graph_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("image_base64", T.StringType()),
    ]
)

ANSWERS = T.StructType(
    [
        T.StructField("question_id", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("graph", T.StringType()),
        T.StructField("graph_description", T.StringType()),
        T.StructField("response_time", T.DoubleType()),
    ]
)

#: Format of status dates, and the years that an arrival date may have.
DATE_FORMAT = "yyyy-MM-dd"
YEARS = (1000, 9999)

#: Stands for the format that fits all status dates, and the formats it is chosen from.
INFERRED_FORMAT = "infer"
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "MM/dd/yyyy",
    "M/d/yyyy",
    "dd/MM/yyyy",
    "d/M/yyyy",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
    "d.M.yyyy",
    "dd MMM yyyy",
    "MMM dd, yyyy",
)

# Columns filled with their mean, and columns filled with their most frequent value.
MEAN_FILLED = ("children", "agent", "company")
MODE_FILLED = ("country",)

# ---- Fixed values: results must carry exactly these ----

# White space as Unicode defines it, as a class that Java and RE2 both read.
WHITE_SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

# Amounts that are set in bold: the number is the first group.
PERCENTAGE_PATTERN = rf"(\d+(\.\d+)?){WHITE_SPACE}*%"
DOLLAR_PATTERN = rf"\${WHITE_SPACE}*(\d+(\.\d+)?)"

# Texts of a CSV field that stand for a missing value.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Lead-time bins, open on the left and closed on the right; the last has no upper edge.
LEAD_TIME_EDGES = (0, 30, 90, 180)
LEAD_TIME_LABELS = ("Short", "Medium", "Long", "Very Long")

MONTH_NAMES = (
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
)

HISTOGRAM_BINS = 20
TOP_COUNTRIES = 10
NEIGHBOURS = 5

DESCRIBE_LABELS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")

# Insight names in report order.
CATEGORIES = (
    "monthly_revenue",
    "revenue_by_hotel",
    "revenue_by_room",
    "revenue_by_segment",
    "overall_cancellation_rate",
    "cancellation_by_hotel",
    "cancellation_by_channel",
    "cancellation_by_lead_time",
    "top_countries",
    "lead_time_stats",
    "length_of_stay_stats",
    "booking_channel_percentage",
    "adr_by_customer_type",
)

# Grouped insights whose values are written as money.
MONEY_CATEGORIES = ("revenue_by_hotel", "revenue_by_room", "revenue_by_segment")

# Category and text of the description documents.
DESCRIPTIONS = (
    (
        "description",
        "This dataset contains booking information for hotels, including city hotels and resort hotels. "
        "It includes details such as booking dates, length of stay, guest numbers, revenue, and more.",
    ),
    (
        "cancellation_rate_description",
        "Overall cancellation rate represents the percentage of bookings that were canceled across all hotels.",
    ),
    (
        "market_segment_description",
        "Revenue by market segment shows the average revenue generated by each market segment such as "
        "Online TA, Offline TA/TO, Direct, Corporate, Groups, etc.",
    ),
)

# Chart name and its description.
CHART_DESCRIPTIONS = {
    "monthly_revenue": "Monthly revenue trends showing total revenue earned by hotels over time.",
    "cancellation_by_hotel": "Cancellation rates by hotel type (city hotels vs. resort hotels).",
    "top_countries": "Top 10 countries by number of bookings.",
    "lead_time_distribution": "Distribution of booking lead times showing how far in advance guests make reservations.",
    "adr_by_customer": "Average daily rate by customer type.",
}

NO_DATA_SENTENCE = "I currently don't have this data available"
NO_DATA_ANSWER = "I currently don't have this data available. I will update you once it's available."
GRAPH_NOTE = " A graph is available to illustrate this data."

# Names set in bold, in this order.
BOLD_SEGMENTS = ("Online TA", "Offline TA/TO", "Direct", "Corporate", "Groups", "Aviation", "Complementary")
BOLD_HOTELS = ("City Hotel", "Resort Hotel")

PROMPT_TEMPLATE = """
You are a hotel booking data analyst. Provide a clear, descriptive, and human-friendly answer to the following question.
Be specific and precise with your response. Format numbers appropriately (e.g., use dollar signs for monetary amounts, percentage signs for rates).

If you're referring to a specific market segment, hotel type, or room type, always mention it by its exact name.
For example, instead of saying "a market segment," state "the Online TA market segment" if that's what the data shows.

If asked about trends, rates, or statistics, provide the exact figures when available, formatted properly:
- For currency values: $X,XXX.XX
- For percentages: XX.XX%
- For counts: X,XXX

If the necessary data is missing, say "I currently don't have this data available. I will update you once it's available."

Use complete sentences and, if applicable, mention that there is a graph available to illustrate the answer.

Context: {context}
Question: {question}
Answer:
"""
