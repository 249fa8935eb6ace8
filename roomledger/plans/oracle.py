"""SQL with the same results as the registered queries, written for DuckDB."""

from __future__ import annotations

from roomledger import schema
from roomledger.functions.vectors import DEFAULT_DIMENSION
from roomledger.plans.sample_tables import SAMPLE_QUESTIONS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(*rows: tuple) -> str:
    return ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


_COLUMNS = (
    "hotel, is_canceled, lead_time, arrival_date_year, arrival_date_month, arrival_date_day_of_month, "
    "stays_in_weekend_nights, stays_in_week_nights, children, agent, company, country, market_segment, "
    "reserved_room_type, customer_type, adr, reservation_status_date"
)

# Named parts of the queries, each built on those before it.
_PARTS = {
    "once": """
        select case when l_linestatus = 'F' then 'City Hotel' else 'Resort Hotel' end as hotel,
               case when l_returnflag = 'R' then 1 else 0 end as is_canceled,
               (((date_diff('day', o_orderdate, l_shipdate) % 400) + 400) % 400)::int as lead_time,
               year(l_shipdate)::int as arrival_date_year,
               monthname(l_shipdate) as arrival_date_month,
               (case when l_linenumber = 7 then 31 else day(l_shipdate) end)::int as arrival_date_day_of_month,
               (l_linenumber % 3)::int as stays_in_weekend_nights,
               (l_quantity::int % 8)::int as stays_in_week_nights,
               (case when l_partkey % 11 = 0 then null else l_partkey % 4 end)::double as children,
               (case when l_suppkey % 10 = 0 then null else l_suppkey end)::double as agent,
               (case when c_custkey % 20 = 0 then c_custkey end)::double as company,
               case when n_name = 'NATION_7' then null else n_name end as country,
               c_mktsegment as market_segment,
               p_type as reserved_room_type,
               o_orderpriority as customer_type,
               l_extendedprice::decimal(18,2) as adr,
               o_orderdate::date::varchar as reservation_status_date,
               l_orderkey, l_linenumber
        from lineitem
        join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey
        join part on l_partkey = p_partkey""",
    "bookings": "select * from once union all select * from once where l_linenumber = 1",
    "mean_filled": """
        select * replace (coalesce(children, (select avg(children) from bookings)) as children,
                          coalesce(agent, (select avg(agent) from bookings)) as agent,
                          coalesce(company, (select avg(company) from bookings)) as company)
        from bookings""",
    "mode_value": """
        select country from bookings where country is not null
        group by country order by count(*) desc, country limit 1""",
    "mode_filled": "select * replace (coalesce(country, (select country from mode_value)) as country) from bookings",
    "filled": "select * replace (coalesce(country, (select country from mode_value)) as country) from mean_filled",
    "clean": """
        select * replace (reservation_status_date::date as reservation_status_date),
               stays_in_weekend_nights + stays_in_week_nights as total_stays,
               try_strptime(arrival_date_year || '-' || arrival_date_month || '-' || arrival_date_day_of_month,
                            '%Y-%B-%d')::date as arrival_date,
               (adr * (stays_in_weekend_nights + stays_in_week_nights))::decimal(29,2) as total_revenue,
               case when lead_time <= 0 then null when lead_time <= 30 then 'Short' when lead_time <= 90 then 'Medium'
                    when lead_time <= 180 then 'Long' when lead_time > 180 then 'Very Long' end as lead_time_bin
        from (select distinct * from filled)""",
    "bin_labels": f"select * from (values {_values(*enumerate(schema.LEAD_TIME_LABELS))}) t(bin_no, lead_time_bin)",
    "monthly_revenue": """
        select strftime(last_day(m), '%Y-%m-%d 00:00:00') as month_end,
               coalesce(sum(total_revenue), 0)::double as revenue
        from (select unnest(generate_series(date_trunc('month', min(arrival_date)),
                                            date_trunc('month', max(arrival_date)), interval 1 month))::date as m
              from clean)
        left join clean on date_trunc('month', arrival_date)::date = m
        group by m""",
    "overall_cancellation_rate": "select sum(is_canceled)::double / count(*)::double * 100 as cancellation_pct from clean",
    "cancellation_by_lead_time": """
        select bin_no, lead_time_bin, sum(is_canceled)::double / count(is_canceled) as cancellation_rate
        from bin_labels left join clean using (lead_time_bin) group by bin_no, lead_time_bin""",
    "top_countries": """
        select country, count(hotel) as bookings from clean where country is not null
        group by country order by bookings desc, country limit 10""",
    "booking_channel_percentage": """
        select market_segment,
               count(hotel)::double / (select count(hotel) from clean where market_segment is not null)::double * 100
                   as booking_pct
        from clean where market_segment is not null group by market_segment""",
}


def _mean_by(key: str, value: str, name: str) -> str:
    return f"""
        select {key}, sum({value})::double / count({value}) as {name}
        from clean where {key} is not null group by {key}"""


_PARTS |= {
    "revenue_by_hotel": _mean_by("hotel", "total_revenue", "avg_revenue"),
    "revenue_by_room": _mean_by("reserved_room_type", "total_revenue", "avg_revenue"),
    "revenue_by_segment": _mean_by("market_segment", "total_revenue", "avg_revenue"),
    "cancellation_by_hotel": _mean_by("hotel", "is_canceled", "cancellation_rate"),
    "cancellation_by_channel": _mean_by("market_segment", "is_canceled", "cancellation_rate"),
    "adr_by_customer_type": _mean_by("customer_type", "adr", "avg_adr"),
}


def _describe(column: str) -> str:
    return f"""
        select unnest([{", ".join(_text(s) for s in schema.DESCRIBE_LABELS)}]) as subkey,
               unnest([count({column})::double, avg({column}), stddev_samp({column}), min({column})::double,
                       quantile_cont({column}, 0.25), quantile_cont({column}, 0.5), quantile_cont({column}, 0.75),
                       max({column})::double]) as value
        from clean"""


_PARTS |= {"lead_time_stats": _describe("lead_time"), "length_of_stay_stats": _describe("total_stays")}


def _category(name: str, subkey: str, value: str) -> str:
    return f"select '{name}' as category, {subkey}::varchar as subkey, ({value})::double as value from {name}"


_PARTS |= {
    "insights": " union all ".join(
        _category(name, subkey, value)
        for name, subkey, value in (
            ("monthly_revenue", "month_end", "revenue"),
            ("revenue_by_hotel", "hotel", "avg_revenue"),
            ("revenue_by_room", "reserved_room_type", "avg_revenue"),
            ("revenue_by_segment", "market_segment", "avg_revenue"),
            ("overall_cancellation_rate", "null", "cancellation_pct"),
            ("cancellation_by_hotel", "hotel", "cancellation_rate"),
            ("cancellation_by_channel", "market_segment", "cancellation_rate"),
            ("cancellation_by_lead_time", "lead_time_bin", "cancellation_rate"),
            ("top_countries", "country", "bookings"),
            ("lead_time_stats", "subkey", "value"),
            ("length_of_stay_stats", "subkey", "value"),
            ("booking_channel_percentage", "market_segment", "booking_pct"),
            ("adr_by_customer_type", "customer_type", "avg_adr"),
        )
    ),
    "insight_texts": f"""
        select 'insight/' || category || coalesce('/' || subkey, '') as doc_id,
               category || coalesce(' - ' || subkey, '') || ': ' ||
               case when value is null then case when subkey is null and category like '%revenue%'
                                                   or category in ('revenue_by_hotel', 'revenue_by_room', 'revenue_by_segment')
                                                 then '$nan' when category like '%rate%' or category like '%percentage%'
                                                 then 'nan%' else 'nan' end
                    when subkey is not null
                         and category in ('revenue_by_hotel', 'revenue_by_room', 'revenue_by_segment')
                    then '$' || printf('%.2f', value)
                    when subkey is null and category like '%revenue%' then '$' || printf('%.2f', value)
                    when category like '%rate%' or category like '%percentage%' then printf('%.2f', value) || '%'
                    else printf('%.2f', value) end as page_content,
               category, subkey
        from insights
        union all
        select 'description/' || category, page_content, category, null
        from (values {_values(*schema.DESCRIPTIONS)}) t(category, page_content)""",
    "chart_files": """
        select 'charts/' || page_id || '/' || case page_id % 6
                   when 0 then 'monthly_revenue' when 1 then 'cancellation_by_hotel' when 2 then 'top_countries'
                   when 3 then 'lead_time_distribution' when 4 then 'adr_by_customer'
                   else 'page_' || page_id end ||
               case when page_id % 7 = 0 then '.v2' else '' end ||
               case when url like '%.html' then '.html' else '.png' end as path,
               html
        from pages""",
    "chart_names": """
        select path, html, split_part(split_part(path, '/', 3), '.', 1) as graph_name
        from chart_files where path like '%.png'""",
    "graphs": f"""
        select 'graph/' || path as doc_id, graph_name,
               coalesce(d.description, 'Graph showing data for ' || replace(graph_name, '_', ' ') || '.') as description,
               base64(encode(html)) as image
        from chart_names
        left join (values {_values(*schema.CHART_DESCRIPTIONS.items())}) d(name, description) on name = graph_name""",
    "documents_all": """
        select doc_id, page_content, category, subkey, null as type, null as graph_name, null as description,
               null as image
        from insight_texts
        union all
        select doc_id, 'Graph: ' || graph_name || ' - ' || description, null, null, 'graph', graph_name, description,
               image
        from graphs""",
    "questions": f"""
        select u.conv_id || '-' || u.turn as question_id,
               u.text || ' ' || [{", ".join(_text(q) for q in SAMPLE_QUESTIONS)}][(u.conv_id + u.turn) % 10 + 1]
                   as question,
               a.text || ' $ ' || a.turn || '.5 and ' || a.turn || ' % at City Hotel via Direct' as raw_answer
        from conversations u
        left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
        where u.role = 'user'""",
}


def _vectors(source: str, key: str, text: str) -> str:
    """Unit vectors of hashed word counts."""
    return f"""
        select {key}, list_transform(counts, lambda n: case when length > 0 then (n / length)::float else 0::float end)
                   as embedding
        from (select {key}, counts, sqrt(list_sum(list_transform(counts, lambda n: n * n))) as length
              from (select {key}, list(coalesce(n, 0)::double order by bucket) as counts
                    from (select {key}, bucket from {source}, range({DEFAULT_DIMENSION}) t(bucket))
                    left join (select {key}, ('0x' || substr(md5(word), 1, 8))::bigint % {DEFAULT_DIMENSION} as bucket,
                                      count(*) as n
                               from (select {key}, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) as word
                                     from {source})
                               where word <> '' group by all) using ({key}, bucket)
                    group by {key}))"""


def _nearest(questions: str, documents: str) -> str:
    return f"""
        select question_id, rank::int as rank, doc_id, round(distance, 6) as distance
        from (select question_id, doc_id, distance,
                     row_number() over (partition by question_id order by distance, doc_id) as rank
              from (select q.question_id, d.doc_id,
                           list_sum(list_transform(list_zip(q.embedding::double[], d.embedding::double[]),
                                                   lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as distance
                    from {questions} q, {documents} d))
        where rank <= {schema.NEIGHBOURS}"""


_PERCENT, _DOLLAR = schema.PERCENTAGE_PATTERN, schema.DOLLAR_PATTERN


def _formatted(text: str) -> str:
    out = f"regexp_replace({text}, '{_PERCENT}', '**\\1%**', 'g')"
    out = f"regexp_replace({out}, '{_DOLLAR}', '**$\\1**', 'g')"
    for name in (*schema.BOLD_SEGMENTS, *schema.BOLD_HOTELS):
        out = f"replace({out}, {_text(name)}, {_text('**' + name + '**')})"
    return out


def _stripped(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{schema.WHITE_SPACE}+', ''), '{schema.WHITE_SPACE}+$', '')"


def _fallback(raw: str, relevant: str) -> str:
    return (
        f"case when {raw} is null or {_stripped(raw)} = '' or not {relevant} "
        f"then {_text(schema.NO_DATA_ANSWER)} else {_stripped(raw)} end"
    )


def _noted(answer: str, graph: str) -> str:
    return (
        f"case when coalesce({graph}, '') <> '' and not contains({answer}, {_text(schema.NO_DATA_SENTENCE)}) "
        f"then {answer} || case when {answer} like '%.' then '' else '.' end || {_text(schema.GRAPH_NOTE)} "
        f"else {answer} end"
    )


_TEMPLATE_START, _TEMPLATE_REST = schema.PROMPT_TEMPLATE.split("{context}")
_TEMPLATE_MIDDLE, _TEMPLATE_END = _TEMPLATE_REST.split("{question}")

_PARTS |= {
    "document_vectors": _vectors("documents_all", "doc_id", "page_content"),
    "question_vectors": _vectors("questions", "question_id", "question"),
    "retrieved": _nearest("question_vectors", "document_vectors"),
    "described": """
        select q.question_id, any_value(q.raw_answer) as raw_answer,
               coalesce(bool_or(d.type is null), false) as has_relevant_info,
               min_by(d.image, r.rank) filter (where d.type = 'graph') as graph,
               min_by(d.description, r.rank) filter (where d.type = 'graph') as graph_description
        from questions q left join retrieved r using (question_id) left join documents_all d using (doc_id)
        group by q.question_id""",
    "formatted": f"""
        select question_id, {_formatted('text')} as answer, graph, graph_description
        from (select *, {_fallback('raw_answer', 'has_relevant_info')} as text from described)""",
    "vector_questions": "select vec_id as question_id, embedding from embeddings",
    "vector_documents": "select vec_id as doc_id, embedding, label from embeddings",
    "near_vectors": _nearest("vector_questions", "vector_documents"),
    "short_vectors": """
        select vec_id as question_id, vec_id as doc_id,
               list_transform(embedding, lambda x: (x::double * 0.0001::double)::float) as embedding from embeddings""",
    "near_short_vectors": _nearest("short_vectors", "short_vectors"),
    "near_described": """
        select question_id, string_agg('vector ' || doc_id || ' of class ' || label, chr(10) || chr(10) order by rank) as context,
               bool_or(label <> 0) as has_relevant_info,
               min_by(base64(encode(doc_id::varchar)), rank) filter (where label = 0) as graph,
               min_by('chart ' || doc_id, rank) filter (where label = 0) as graph_description
        from near_vectors join vector_documents using (doc_id) group by question_id""",
    "log": """
        select event_id + 1 as question_number, props as question,
               'Seen: ' || event_type || case when event_id % 3 = 0
                   then ' (Response time: ' || printf('%.2f', value) || ' seconds)' else '' end as answer,
               case event_type when 'view' then base64(encode(props)) when 'click' then '' end as graph,
               round(value * 1000000)::bigint / 1000000.0::double as response_time
        from events""",
    "turns": "select * from conversations",
    "answer_log": """
        select conv_id || '-' || turn as question_id, response_time
        from conversations join log on question_number = conv_id * 10 + turn + 1 where role = 'user'""",
    "timed": f"""
        select question_id, case when response_time is null or ends_with(answer, note) then answer
                   else answer || chr(10) || chr(10) || note end as answer, graph, graph_description, response_time
        from (select question_id, {_noted('answer', 'graph')} as answer, graph, graph_description, response_time,
                     '(Response time: ' || printf('%.2f', response_time) || ' seconds)' as note
              from formatted left join answer_log using (question_id))""",
    "timed_and_asked": "select * from timed join questions using (question_id)",
}



def _stats(value: str, source: str, places: int) -> str:
    return f"""
        select subkey, round(value, {places}) as value from (
            select unnest([{", ".join(_text(s) for s in schema.DESCRIBE_LABELS)}]) as subkey,
                   unnest([count(x)::double, avg(x), stddev_samp(x), min(x), quantile_cont(x, 0.25), quantile_cont(x, 0.5),
                           quantile_cont(x, 0.75), max(x)]) as value
            from (select {value} as x from {source}))"""


_SHOWN = (
    _COLUMNS.replace("adr,", "adr::double as adr,") + ", l_orderkey, l_linenumber"
)
_SELECTS = {
    "scan_bookings": (f"select {_COLUMNS.replace('adr,', 'adr::double as adr,')} from bookings", "bookings"),
    "scan_typed_columns": (
        f"""select distinct {_SHOWN}, stays_in_week_nights::double as points, stays_in_weekend_nights::bigint as visits,
                   is_canceled = 1 as member, case when l_linenumber = 1 then 'A1' else stays_in_week_nights::varchar end as code
            from bookings""",
        "bookings",
    ),
    "scan_line_breaks": ("select page_id::varchar as page_id, url, html from pages", None),
    "status_date_formats": (
        "select l_orderkey, l_linenumber, reservation_status_date::date::varchar as found, "
        "reservation_status_date::date::varchar as given from bookings",
        "bookings",
    ),
    "price_stats": (_stats("l_extendedprice", "lineitem", 4), None),
    "revenue_stats": (_stats("total_revenue::double", "clean", 4), "clean"),
    "price_histogram": (
        """with bounds as (select min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem),
        edges as (
            select i, case when i = 20 then high else i * ((high - low) / 20.0::double) + low end as edge
            from range(21) t(i) cross join bounds)
        select a.i::int as bin, round(any_value(a.edge), 6) as bin_start, round(any_value(b.edge), 6) as bin_end,
               count(l_extendedprice) as count
        from edges a join edges b on b.i = a.i + 1
        left join lineitem on l_extendedprice >= a.edge and (l_extendedprice < b.edge or a.i = 19)
        group by a.i""",
        None,
    ),
    "impute_mean": (f"select {_SHOWN} from mean_filled", "mean_filled"),
    "impute_mode": (f"select {_SHOWN} from mode_filled", "mode_filled"),
    "dedup_rows": (f"select {_SHOWN} from (select distinct * from bookings)", "bookings"),
    "parse_status_date": (
        "select l_orderkey, l_linenumber, reservation_status_date::date::varchar as reservation_status_date from bookings",
        "bookings",
    ),
    "derive_stays": (
        "select l_orderkey, l_linenumber, stays_in_weekend_nights + stays_in_week_nights as total_stays from bookings",
        "bookings",
    ),
    "derive_arrival_date": (
        "select l_orderkey, l_linenumber, try_strptime(arrival_date_year || '-' || arrival_date_month || '-' || "
        "arrival_date_day_of_month, '%Y-%B-%d')::date::varchar as arrival_date from bookings",
        "bookings",
    ),
    "derive_revenue": (
        "select l_orderkey, l_linenumber, (adr * (stays_in_weekend_nights + stays_in_week_nights))::double "
        "as total_revenue from bookings",
        "bookings",
    ),
    "lead_time_bins": (
        "select l_orderkey, l_linenumber, lead_time, case when lead_time <= 0 then null when lead_time <= 30 then 'Short' "
        "when lead_time <= 90 then 'Medium' when lead_time <= 180 then 'Long' when lead_time > 180 then 'Very Long' end "
        "as lead_time_bin from bookings",
        "bookings",
    ),
    "clean_bookings": (
        "select * replace (adr::double as adr, reservation_status_date::varchar as reservation_status_date, "
        "arrival_date::varchar as arrival_date, total_revenue::double as total_revenue) from clean",
        "clean",
    ),
    **{
        name: (f"select * from {name}", name)
        for name in (
            "monthly_revenue", "revenue_by_hotel", "revenue_by_room", "revenue_by_segment",
            "overall_cancellation_rate", "cancellation_by_hotel", "cancellation_by_channel",
            "cancellation_by_lead_time", "top_countries", "booking_channel_percentage", "adr_by_customer_type",
        )
    },
    "lead_time_stats": ("select subkey, round(value, 6) as value from lead_time_stats", "lead_time_stats"),
    "length_of_stay_stats": ("select subkey, round(value, 6) as value from length_of_stay_stats", "length_of_stay_stats"),
    "insights_long": (
        "select category, subkey, round(value, 6) as value, list_position(["
        + ", ".join(_text(c) for c in schema.CATEGORIES)
        + "], category)::int as category_no from insights",
        "insights",
    ),
    "insights_json": ("select category, subkey, round(value, 6) as value from insights", "insights"),
    "lead_time_histogram": (
        """with bounds as (select min(lead_time)::bigint as low, max(lead_time)::bigint as high from clean)
        select bin::int as bin, round(low + bin * (high - low) / 20.0::double, 6) as bin_start,
               round(low + (bin + 1) * (high - low) / 20.0::double, 6) as bin_end, count(lead_time) as count
        from range(20) t(bin) cross join bounds
        left join clean on least((lead_time - low) * 20 // (high - low), 19) = bin
        group by bin, low, high""",
        "clean",
    ),
    "chart_series": (
        """select case category when 'adr_by_customer_type' then 'adr_by_customer' else category end as chart,
               subkey as label, round(value, 6) as value
        from insights
        where category in ('monthly_revenue', 'cancellation_by_hotel', 'top_countries', 'adr_by_customer_type')
        union all
        select 'lead_time_distribution', bin::varchar, count(lead_time)::double
        from range(20) t(bin) cross join (select min(lead_time)::bigint as low, max(lead_time)::bigint as high from clean)
        left join clean on least((lead_time - low) * 20 // (high - low), 19) = bin
        group by bin""",
        "insights",
    ),
    "insight_documents": ("select * from insight_texts", "insight_texts"),
    "graph_documents": (
        "select doc_id, page_content, type, graph_name, description, image from documents_all where type = 'graph'",
        "documents_all",
    ),
    "documents_all": ("select * from documents_all", "documents_all"),
    "embed_documents": (
        "select doc_id, array_to_string(list_transform(embedding, lambda x: round(x::double * 1000000)::bigint), ',') "
        f"as vector from ({_vectors('documents', 'doc_id', 'text')})",
        None,
    ),
    "knn_top5": ("select * from near_vectors", "near_vectors"),
    "knn_top5_by_cells": ("select * from near_vectors", "near_vectors"),
    "knn_top5_by_stream": ("select * from near_vectors", "near_vectors"),
    "knn_short_vectors": ("select * from near_short_vectors", "near_short_vectors"),
    "knn_short_vectors_by_stream": ("select * from near_short_vectors", "near_short_vectors"),
    "knn_short_vectors_by_cells": ("select * from near_short_vectors", "near_short_vectors"),
    "retrieve_documents": ("select * from retrieved", "retrieved"),
    "rag_prompt": (
        f"select question_id, {_text(_TEMPLATE_START)} || context || {_text(_TEMPLATE_MIDDLE)} || "
        f"'What is near vector ' || question_id || '?' || {_text(_TEMPLATE_END)} as prompt from near_described",
        "near_described",
    ),
    "has_relevant_info": ("select question_id, has_relevant_info from near_described", "near_described"),
    "first_graph": ("select question_id, graph, graph_description from near_described", "near_described"),
    "answer_fallback": (
        f"select conv_id, turn, {_fallback('raw', '(conv_id % 5 <> 0)')} as answer from (select *, "
        "case when turn % 4 = 3 then ' ' || chr(10) || chr(9) || chr(160) || ' ' "
        "else chr(160) || chr(10) || '  ' || text || ' ' || chr(8195) || chr(9) end as raw from turns)",
        "turns",
    ),
    "format_answer": (
        f"select conv_id, turn, {_formatted('raw')} as answer from (select *, text || ' $ ' || turn || '.5 and ' || turn || chr(160) "
        "|| '% for $1,234.50 at City Hotel, Resort Hotels, Directly or Offline TA/TO' as raw from turns)",
        "turns",
    ),
    "answer_graph_note": (
        f"select conv_id, turn, {_noted('raw', 'graph')} as answer from (select *, "
        "case when turn % 3 = 0 then text || ' I currently don''t have this data available' "
        "when turn % 3 = 1 then text || '!' else text end as raw, "
        "case when conv_id % 3 = 0 then role when conv_id % 3 = 1 then '' end as graph from turns)",
        "turns",
    ),
    "answer_questions": (
        f"select question_id, {_noted('answer', 'graph')} as answer, graph, graph_description from formatted",
        "formatted",
    ),
    "timed_answers": ("select * from timed", "timed"),
    "answers_average_time": (
        "select round(coalesce(avg(response_time), 0), 6) as average_response_time, count(*) as questions from timed "
        "where response_time is not null",
        "timed",
    ),
    "answers_report": (
        "select question_id as question_number, question, answer, case when coalesce(graph, '') <> '' then 'Yes' else 'No' end "
        "as has_graph, coalesce(printf('%.2f', response_time), 'nan') as response_seconds from timed_and_asked",
        "timed_and_asked",
    ),
    "answer_time_suffix": (
        "select question_number, case when ends_with(answer, note) then answer else answer || chr(10) || chr(10) || note "
        "end as answer from (select *, '(Response time: ' || printf('%.2f', response_time) || ' seconds)' as note from log)",
        "log",
    ),
    "response_time": ("select question_number, response_time from log", "log"),
    "evaluate_latency": (
        "select round(coalesce(avg(response_time), 0), 6) as average_response_time, count(*) as questions from log",
        "log",
    ),
    "evaluation_report": (
        "select question_number, question, answer, case when coalesce(graph, '') <> '' then 'Yes' else 'No' end as has_graph, "
        "printf('%.2f', response_time) as response_seconds from log",
        "log",
    ),
    "ask_revenue_of_month": (
        "select coalesce(sum(total_revenue), 0)::double as revenue from clean "
        "where arrival_date >= date '1997-07-01' and arrival_date < date '1997-08-01'",
        "clean",
    ),
    "ask_cancellations_by_country": (
        "select country, sum(is_canceled)::bigint as canceled from clean where country is not null "
        "group by country order by canceled desc, country limit 10",
        "clean",
    ),
    "ask_average_price": ("select sum(adr)::double / count(adr) as avg_adr from clean", "clean"),
    "ask_city_hotel_cancellation": ("select * from cancellation_by_hotel where hotel = 'City Hotel'", "cancellation_by_hotel"),
    "ask_top_segment_by_bookings": (
        "select * from booking_channel_percentage order by booking_pct desc, market_segment limit 1",
        "booking_channel_percentage",
    ),
    "ask_top_segment_by_cancellation": (
        "select * from cancellation_by_channel order by cancellation_rate desc, market_segment limit 1",
        "cancellation_by_channel",
    ),
    "ask_monthly_trend": ("select * from monthly_revenue", "monthly_revenue"),
    "ask_lead_time_and_cancellation": ("select * from cancellation_by_lead_time", "cancellation_by_lead_time"),
    "ask_top_customer_type_by_revenue": (
        "select customer_type, sum(total_revenue)::double as revenue from clean where customer_type is not null "
        "group by customer_type order by revenue desc, customer_type limit 1",
        "clean",
    ),
    "ask_resort_hotel_stay": (
        "select sum(total_stays)::double / count(total_stays) as avg_nights from clean where hotel = 'Resort Hotel'",
        "clean",
    ),
}


def _needed(last: str | None) -> list[str]:
    """Parts that a part is built on, itself included, in order."""
    names, wanted = list(_PARTS), set()

    def visit(name: str) -> None:
        if name in wanted:
            return
        wanted.add(name)
        words = set(_PARTS[name].replace("(", " ").replace(")", " ").replace(",", " ").split())
        for other in names:
            if other != name and other in words:
                visit(other)

    if last is not None:
        visit(last)
    return sorted(wanted, key=names.index)


def _statement(select: str, last: str | None) -> str:
    parts = _needed(last)
    if not parts:
        return select
    heads = [f"{name} as materialized ({_PARTS[name]})" for name in parts]
    if select.lstrip().startswith("with "):
        return "with " + ",\n".join(heads) + ",\n" + select.lstrip()[len("with ") :]
    return "with " + ",\n".join(heads) + "\n" + select


ORACLE_SQL: dict[str, str] = {name: _statement(select, last) for name, (select, last) in _SELECTS.items()}
