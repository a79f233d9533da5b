"""The registered queries as DuckDB SQL over the same tables, written independently of the Spark plans."""

from __future__ import annotations

import json

from tillcast.constants import FEATURE_NAMES
from tillcast.operators.insight import PROMPT_HEAD
from tillcast.sources.testbed import FILE_ROWS, REQUEST_STEPS

_J = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"

_SALES = f"""sales as (
  select n_name as restaurant_id, c_mktsegment as location_id, cast(o_orderdate as date) as date,
         cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(18,2)) as daily_sales_total
  from {_J} group by 1, 2, 3)"""

_SINGLE = f"""single_lines as (
  select n_name as restaurant_id, concat('customer_', cast(c_custkey as varchar)) as location_id,
         cast(o_orderdate as date) as date, o_orderkey % 2 = 1 as is_current,
         case when c_custkey % 97 <> 0 then cast(o_totalprice as decimal(18,2)) end as amount from {_J}),
single as (
  select restaurant_id, location_id, date, cast(sum(amount) as decimal(18,2)) as daily_sales_total
  from single_lines group by 1, 2, 3),
tenants as (
  select n_name as restaurant_id, concat('customer_', cast(c_custkey as varchar)) as location_id
  from customer join nation on c_nationkey = n_nationkey
  union all
  select n_name, concat('supplier_', cast(s_suppkey as varchar)) from supplier join nation on s_nationkey = n_nationkey)"""


def _average(source: str) -> str:
    """Average rounded half up at four decimals, in whole numbers."""
    return f"""avg_model as (
  select restaurant_id, location_id, n as training_rows,
         cast(cast((2 * s + n) // (2 * n) as decimal(22,0)) * cast(0.0001 as decimal(5,4)) as decimal(22,4)) as avg4
  from (select restaurant_id, location_id, count(*) as n,
               sum(cast(daily_sales_total * 10000 as hugeint)) as s
        from {source} group by 1, 2))"""


_FORECAST = """forecast as (
  with recursive f as (
    select restaurant_id, location_id, 0 as day_index, avg4 as amount from avg_model
    union all
    select restaurant_id, location_id, day_index + 1,
           cast(round(amount * 1.02, 2) as decimal(22,4)) from f where day_index < 7)
  select restaurant_id, location_id, cast(day_index as integer) as day_index,
         cast(amount as decimal(18,2)) as predicted_sales
  from f where day_index > 0)"""

_PLAN_COLUMNS = """cast(predicted_sales as double) as predicted_sales,
  cast(case when predicted_sales <= 0 then 1
       else greatest(1, floor(predicted_sales / 600)) end as integer) as recommended_staff,
  cast(round(predicted_sales * 0.45, 2) as double) as ingredients_needed,
  cast(round(predicted_sales * cast(0.04 as decimal(3,2)), 2) as double) as estimated_meals"""

_RECENT = """recent as (
  select restaurant_id, location_id, date, daily_sales_total
  from (select *, row_number() over (partition by restaurant_id, location_id order by date desc) as r
        from sales) where r <= 7)"""

_RAW_UPLOAD = f"""raw_upload as (
  select o_orderkey as upload_id, o_orderkey % 2 as batch,
    case when o_orderkey % 23 = 0 then '' else n_name end as restaurant_id,
    c_mktsegment as location_id,
    case when o_orderkey % 29 = 0 then '2025-13-01' when o_orderkey % 31 = 0 then null
         when o_orderkey % 37 = 0 then '2025-1-1'
         else cast(cast(o_orderdate as date) as varchar) end as date_text,
    case when o_orderkey % 17 = 0 then 'abc' when o_orderkey % 19 = 0 then '-5'
         when o_orderkey % 41 = 0 then '' when o_orderkey % 43 = 0 then 'nan'
         else cast(cast(o_totalprice as decimal(18,2)) as varchar) end as sales_text
  from {_J})"""

_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"

_CHECKED = f"""{_RAW_UPLOAD},
checked as (
  select *, coalesce(nullif(restaurant_id, ''), 'restaurant_001') as rid,
         coalesce(nullif(location_id, ''), 'location_001') as lid,
    case when date_text is null or not regexp_matches(date_text, '{_DATE}')
              or try_cast(substr(date_text, 1, 10) as date) is null then 'invalid_date'
         when not regexp_matches(sales_text, '{_NUMBER}') then 'invalid_sales'
         when try_cast(sales_text as double) < 0 then 'negative_sales' end as reason
  from raw_upload),
good as (
  select upload_id, batch, rid as restaurant_id, lid as location_id,
         cast(substr(date_text, 1, 10) as date) as date,
         cast(sales_text as decimal(18,2)) as daily_sales_total
  from checked where reason is null)"""

_TENANT_OF_EVENT = """concat('restaurant_', cast(user_id % 5 as varchar)) as restaurant_id,
  concat('location_', cast(user_id % 3 as varchar)) as location_id"""

_RUN_LOG = """run_log as (
  select event_id as seq, concat('run_', cast(user_id as varchar)) as run_id, event_type as step, user_id,
    case when event_type = 'error' then 'error' when event_id % 10 = 0 then 'skipped' else 'ok' end as status,
    cast(floor(value * 10) as bigint) as duration_ms,
    case when event_id % 13 = 0 then concat('!', props) when event_id % 17 = 0 then '[1]'
         else props end as payload_json
  from events)"""

_REQUESTS = """run_requests as (
  select event_id as request_id,
    case when event_id % 7 = 0 then 'click,view, click,bogus' when event_id % 5 = 0 then ' '
         else concat(event_type, ',view,purchase') end as steps,
    case when event_id % 3 = 0 then 'view' else '' end as exclude_steps,
    case when event_id % 11 = 0 then 'purchase' else '' end as start_at,
    case when event_id % 19 = 0 then 'signup' else '' end as stop_after,
    case when event_id % 2 = 0 then 'no' else 'Yes' end as strict
  from events)"""

_KNOWN = "[" + ", ".join(f"'{s}'" for s in REQUEST_STEPS) + "]"


def _list(column: str) -> str:
    return f"list_filter(list_transform(string_split({column}, ','), lambda x: trim(x)), lambda x: x <> '')"


def _first_seen(values: str) -> str:
    """Duplicates removed, first occurrence kept."""
    return (
        f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"
    )


_AUDIT = f"""{_REQUESTS},
parts as (
  select request_id, {_list('steps')} as asked, {_list('exclude_steps')} as excluded,
         nullif(trim(start_at), '') as start_at, nullif(trim(stop_after), '') as stop_after,
         lower(strict) not in ('0', 'false', 'no', 'n', 'off') as strict
  from run_requests),
named as (
  select request_id, start_at, stop_after, strict, excluded,
    case when len(asked) = 0 then {_KNOWN}
         else list_filter(asked, lambda x: list_contains({_KNOWN}, x)) end as picked,
    list_filter(asked, lambda x: not list_contains({_KNOWN}, x)) as bad_steps,
    list_filter(list_concat(list_filter([start_at, stop_after], lambda x: x is not null), excluded),
                lambda x: not list_contains({_KNOWN}, x)) as bad_selectors
  from parts),
uniq as (
  select request_id, start_at, stop_after, strict, excluded,
    {_first_seen('picked')} as selected, {_first_seen('bad_steps')} as bad_steps,
    {_first_seen('bad_selectors')} as bad_selectors
  from named),
cut as (
  select *, list_filter(selected, lambda x: not list_contains(excluded, x)) as rest from uniq),
begun as (
  select *, case when list_contains(rest, start_at) then rest[list_position(rest, start_at):]
                 else rest end as tail from cut),
ended as (
  select *, case when list_contains(tail, stop_after) then tail[:list_position(tail, stop_after)]
                 else tail end as sliced,
         strict and (len(bad_steps) > 0 or len(bad_selectors) > 0) as refused from begun),
final as (select *, case when refused then selected else sliced end as plan from ended)"""

_ADVICE_PROMPT = PROMPT_HEAD.replace("'", "''")
_MODEL_USED = json.dumps(
    {"model_name": "average_daily_sales_model", "model_version": "1.0"}, separators=(",", ":")
)
_FEATURES_JSON = json.dumps(FEATURE_NAMES, separators=(",", ":"))

_LINES = """lines as (
  select concat('[', cast(cast(ts as date) as varchar), 'T00:00:00] event=step_done run_id=run_',
    cast(user_id as varchar), ' step=', event_type, ' duration_ms=',
    cast(cast(floor(value * 10) as bigint) as varchar), ' status=',
    case when event_type = 'error' then 'error' else 'ok' end) as line from events)"""

_PRIOR = """curve as (
  select cast(i as double) as x,
         greatest(0.0, (1200.0 + 0.9 * i) * (1 + 0.2 * sin(2 * pi() * (i % 7) / 7.0)) + 30 * sin(0.13 * i)) as y
  from range(365) t(i)),
prior as (
  select regr_intercept(y, x) as intercept, regr_slope(y, x) as slope, count(*) as n from curve),
prior_fit as (
  select any_value(p.intercept) as intercept, any_value(p.slope) as slope,
         stddev_pop(y - (p.intercept + p.slope * x)) as std_error, any_value(p.n) as n
  from curve, prior p)"""


def _trend(source: str) -> str:
    return f"""series as (
  select restaurant_id, location_id, cast(daily_sales_total as double) as y,
         cast(row_number() over (partition by restaurant_id, location_id order by date) - 1 as double) as x
  from {source}),
lines as (
  select restaurant_id, location_id, count(*) as n,
         coalesce(regr_intercept(y, x), avg(y)) as intercept, coalesce(regr_slope(y, x), 0) as slope
  from series group by 1, 2),
trend as (
  select restaurant_id, location_id, any_value(intercept) as intercept, any_value(slope) as slope,
         stddev_pop(y - (intercept + slope * x)) as std_error, any_value(n) as n
  from series join lines using (restaurant_id, location_id) group by 1, 2)"""


# Stored runs built as text and read back with JSON functions.
_SALE = """concat('{"date":"', cast(cast(ts as date) as varchar), '","daily_sales_total":', cast(cast(value as decimal(18,2)) as varchar), '}')"""


def _ingestion(entries: str) -> str:
    return f"""concat('{{"step":"1_data_ingestion","data":{{"restaurant_id":"restaurant_', cast(user_id % 5 as varchar), '","sales":[', {entries}, ']}}}}')"""


_OTHER = f"""concat('{{"step":"', event_type, '","data":{{"sales":[', {_SALE}, ']}}}}')"""
_LISTED = f"""case event_id % 5 when 0 then concat({_SALE}, ',', {_SALE}) when 1 then concat({_SALE}, ',5')
  when 2 then concat('{{"date":"', cast(cast(ts as date) as varchar), '","daily_sales_total":"', cast(cast(value as decimal(18,2)) as varchar), '"}}')
  when 3 then '' else {_SALE} end"""
_STORED = f"""payloads as (
  select event_id as seq, concat('{{"results":[', case event_id % 7 when 0 then {_OTHER}
    when 1 then concat({_ingestion("'7'")}, ',', {_ingestion(_SALE)}) else concat({_OTHER}, ',', {_ingestion(_LISTED)}) end, ']}}') as run
  from events),
stored as (select seq, cast(case when seq % 3 = 0 then concat('{{"result":', run, '}}') else run end as json) as payload from payloads),
listed as (
  select seq, cast(json_extract(coalesce(json_extract(payload, '$.result'), payload), '$.results') as json[]) as l from stored),
numbered as (select seq, unnest(range(1, len(l) + 1)) as i, l from listed),
steps as (
  select seq, concat('run_', cast(seq as varchar)) as run_id, i, json_extract_string(l[i], '$.data.restaurant_id') as restaurant_id,
         cast(json_extract(l[i], '$.data.sales') as json[]) as entries
  from numbered where json_extract_string(l[i], '$.step') = '1_data_ingestion' and json_type(l[i], '$.data') = 'OBJECT')"""
_ENTRY = """json_extract_string(e, '$.date') as date,
  case when json_type(e, '$.daily_sales_total') in ('DOUBLE', 'UBIGINT', 'BIGINT')
       then cast(json_extract_string(e, '$.daily_sales_total') as double) end as daily_sales_total"""

_PLANNED = f"with {_SALES}, {_average('sales')}, {_FORECAST}"

_PROMPTED = f"""{_PLANNED}, {_RECENT},
r as (
  select restaurant_id, location_id, string_agg(concat('{{"date":"', cast(date as varchar),
    '","daily_sales_total":', cast(daily_sales_total as varchar), '}}'), ',' order by date) as sales
  from recent group by 1, 2),
f as (
  select restaurant_id, location_id, string_agg(concat('{{"predicted_sales":',
    cast(predicted_sales as varchar), '}}'), ',' order by day_index) as days
  from forecast group by 1, 2),
p as (
  select restaurant_id, location_id, concat('{_ADVICE_PROMPT}', chr(10), '- restaurant_id: ', restaurant_id,
    chr(10), '- location_id: ', location_id, chr(10), '- horizon: 7', chr(10),
    '- model_used: {_MODEL_USED}', chr(10), '- recent_sales: [', sales, ']', chr(10),
    '- forecast: [', days, ']') as prompt
  from f join r using (restaurant_id, location_id))"""

ORACLE: dict[str, str] = {
    "daily_sales": f"""with {_SALES}
select restaurant_id, location_id, cast(date as varchar) as date,
  cast(daily_sales_total as double) as daily_sales_total from sales""",
    "upload_validation": f"with {_CHECKED} select upload_id, reason from checked",
    "upload_rejects": f"""with {_CHECKED}
select rid as restaurant_id, lid as location_id, reason, count(*) as n
from checked where reason is not null group by 1, 2, 3""",
    "upload_file_verdict": f"""with {_RAW_UPLOAD},
files as (
  select concat('batch_', cast(cast(floor(upload_id / {FILE_ROWS}) as bigint) as varchar), '.csv') as file_name,
         bool_and(regexp_matches(sales_text, '{_NUMBER}')) as good, count(*) as n
  from raw_upload group by 1)
select file_name, case when good then 'csv_file' else 'simulated_fallback' end as sales_source,
  case when good then n else 0 end as sales_rows_loaded from files""",
    "upload_upsert": f"""with {_CHECKED}
select restaurant_id, location_id, cast(date as varchar) as date,
  cast(daily_sales_total as double) as daily_sales_total
from (select *, row_number() over (partition by restaurant_id, location_id, date
                                   order by batch desc, upload_id desc) as r from good)
where r = 1""",
    "upload_counts": f"""with {_CHECKED},
marked as (
  select batch, row_number() over (partition by restaurant_id, location_id, date
                                   order by batch, upload_id) as r from good),
counted as (
  select batch, count(*) filter (where r = 1) as inserted, count(*) filter (where r > 1) as updated
  from marked group by 1),
refused as (select batch, count(*) filter (where reason is not null) as skipped from checked group by 1)
select batch, coalesce(inserted, 0) as inserted, coalesce(updated, 0) as updated, skipped
from refused left join counted using (batch)""",
    "upload_against_table": f"""with {_CHECKED},
stored as (select distinct restaurant_id, location_id, date from good where batch = 0),
hits as (
  select g.*, s.date is not null as known,
    row_number() over (partition by g.restaurant_id, g.location_id, g.date order by g.upload_id) as r
  from good g left join stored s using (restaurant_id, location_id, date) where g.batch = 1)
select count(*) filter (where not known and r = 1) as inserted,
  count(*) filter (where known or r > 1) as updated,
  (select count(*) from checked where batch = 1 and reason is not null) as skipped
from hits""",
    "upload_applied_to_table": f"""with {_CHECKED}
select restaurant_id, location_id, cast(date as varchar) as date,
  cast(arg_max(daily_sales_total, batch * 1000000000 + upload_id) as double) as daily_sales_total
from good group by restaurant_id, location_id, date""",
    "running_daily_totals": f"""
with e as (select {_TENANT_OF_EVENT}, cast(ts as date) as d, cast(value as decimal(18,2)) as v from events)
select restaurant_id, location_id, cast(d as varchar) as date, cast(sum(v) as double) as daily_sales_total
from e group by 1, 2, 3""",
    "tenant_file_resolution": """
select distinct n_name as restaurant_id, c_mktsegment as location_id,
  case when n_nationkey % 3 = 0 then concat(replace(n_name, ' ', '_'), '__', c_mktsegment, '__sales.csv')
       when n_nationkey % 3 = 1 then concat(replace(n_name, ' ', '_'), '__sales.csv')
       else 'upload_sales.csv' end as file_name,
  cast(n_nationkey % 3 + 1 as integer) as rank
from customer join nation on c_nationkey = n_nationkey""",
    "warehouse_tables": f"""with {_SALES}
select 'sales' as table_name, count(*) as row_count from sales
union all select 'inventory', count(*) from (
  select distinct l_partkey, cast(l_shipdate as date) from lineitem)
union all select 'attendance', count(*) from (select distinct user_id, cast(ts as date) from events)""",
    "hourly_sales_profile": f"""
with e as (select {_TENANT_OF_EVENT}, cast(hour(ts) as integer) as hour, value from events),
h as (select restaurant_id, location_id, hour, sum(value) as v from e group by 1, 2, 3)
select restaurant_id, location_id, hour,
  round(v / nullif(sum(v) over (partition by restaurant_id, location_id), 0), 6) as share from h""",
    "inventory_usage_rate": """
select l_partkey as part_key,
  round(sum(l_quantity) / count(distinct cast(l_shipdate as date)), 6) as usage_rate
from lineitem group by 1""",
    "waste_rate": """
select l_partkey as part_key,
  round(sum(case when l_returnflag = 'R' then l_quantity else 0 end) / nullif(sum(l_quantity), 0), 6) as waste_rate
from lineitem group by 1""",
    "labor_hours": """
select user_id, cast(cast(ts as date) as varchar) as date,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0, 6) as labor_hours
from events group by user_id, cast(ts as date)""",
    "feature_store": f"""
select distinct n_name as restaurant_id, c_mktsegment as location_id,
  '{_FEATURES_JSON}' as features_json from {_J}""",
    "avg_model": f"""with {_SALES}, {_average('sales')}
select restaurant_id, location_id, cast(avg4 as double) as avg_daily_sales, training_rows from avg_model""",
    "model_status": f"""with {_SINGLE},
n as (select restaurant_id, location_id, count(*) as n, count(daily_sales_total) as good from single group by 1, 2)
select restaurant_id, location_id,
  case when n is null then 'skipped' when good = 0 then 'error' else 'ok' end as status,
  case when n is null then 'missing_sales_data_from_1_data_ingestion' when good = 0 then 'no_numeric_sales' end as reason,
  case when coalesce(good, 0) = 0 then 'error' else 'ok' end as prediction_status,
  case when n is null then 'model_not_found' when good = 0 then 'invalid_model_format' end as prediction_reason
from tenants left join n using (restaurant_id, location_id)""",
    "next_day_prediction": f"""with {_SALES}, {_average('sales')}
select restaurant_id, location_id,
  cast(round(avg4 * 1.02, 2) as double) as predicted_next_day_sales from avg_model""",
    "trend_model": f"""with {_SALES}, {_trend('sales')}
select restaurant_id, location_id, round(intercept, 4) as intercept, round(slope, 4) as slope,
  round(std_error, 4) as std_error, n as rows from trend where n >= 2""",
    "trend_model_cold_start": f"""with {_SINGLE}, priced as (select * from single where daily_sales_total is not null), {_trend('priced')}, {_PRIOR}
select t.restaurant_id, t.location_id,
  round(case when f.n >= 2 then f.intercept else p.intercept end + 1e-6, 4) as intercept,
  round(case when f.n >= 2 then f.slope else p.slope end + 1e-6, 4) as slope,
  round(case when f.n >= 2 then f.std_error else p.std_error end + 1e-6, 4) as std_error,
  case when f.n >= 2 then f.n else p.n end as rows,
  case when f.n >= 2 then 'real_pipeline_sales' else 'synthetic_fallback' end as training_source
from tenants t left join trend f using (restaurant_id, location_id) cross join prior_fit p""",
    "forecast_7d": f"""{_PLANNED}
select restaurant_id, location_id, day_index, cast(predicted_sales as double) as predicted_sales
from forecast""",
    "staffing_plan": f"""{_PLANNED}
select restaurant_id, location_id, day_index, predicted_sales, recommended_staff
from (select restaurant_id, location_id, day_index, {_PLAN_COLUMNS} from forecast)""",
    "inventory_plan": f"""{_PLANNED}
select restaurant_id, location_id, day_index, predicted_sales, ingredients_needed, estimated_meals
from (select restaurant_id, location_id, day_index, {_PLAN_COLUMNS} from forecast)""",
    "plans_joined": f"{_PLANNED} select restaurant_id, location_id, day_index, {_PLAN_COLUMNS} from forecast",
    "nested_plans": f"""{_PLANNED},
p as (
  select restaurant_id, location_id, day_index, cast(predicted_sales as varchar) as x,
    cast(cast(case when predicted_sales <= 0 then 1
         else greatest(1, floor(predicted_sales / 600)) end as integer) as varchar) as staff,
    cast(cast(round(predicted_sales * 0.45, 2) as decimal(18,2)) as varchar) as ingredients,
    cast(cast(round(predicted_sales * cast(0.04 as decimal(3,2)), 2) as decimal(18,2)) as varchar) as meals
  from forecast)
select restaurant_id, location_id,
  concat('[', string_agg(x, ',' order by day_index), ']') as forecast,
  concat('[', string_agg(concat('{{"day_index":', cast(day_index as varchar), ',"predicted_sales":', x,
    ',"recommended_staff":', staff, '}}'), ',' order by day_index), ']') as staffing_plan,
  concat('[', string_agg(concat('{{"day_index":', cast(day_index as varchar), ',"predicted_sales":', x,
    ',"ingredients_needed":', ingredients, ',"estimated_meals":', meals, '}}'), ',' order by day_index),
    ']') as inventory_plan
from p group by 1, 2""",
    "forecast_current_or_recomputed": f"""with {_SINGLE},
chosen as (
  select restaurant_id, location_id, date, sum(amount) as daily_sales_total
  from single_lines l
  where amount is not null and (is_current or not exists (
    select 1 from single_lines c where c.is_current and c.amount is not null
      and c.restaurant_id = l.restaurant_id and c.location_id = l.location_id))
  group by 1, 2, 3),
{_average('chosen')}, {_FORECAST}
select restaurant_id, location_id, day_index, cast(predicted_sales as double) as predicted_sales
from forecast""",
    "dashboard": f"""{_PLANNED}
select restaurant_id, location_id, day_index, {_PLAN_COLUMNS},
  'skipped' as insight_status, cast(null as varchar) as risk_level, cast(0 as integer) as n_actions
from forecast""",
    "recent_sales": f"""with {_SALES}, {_RECENT}
select restaurant_id, location_id, cast(date as varchar) as date,
  cast(daily_sales_total as double) as daily_sales_total from recent""",
    "insight_prompt": f"""{_PROMPTED}
select restaurant_id, location_id, prompt,
  case when length(prompt) <= 600 then prompt else concat(substr(prompt, 1, 597), '...') end as prompt_preview
from p""",
    "insight_skipped": f"""{_PROMPTED}
select restaurant_id, location_id, 'skipped' as insight_status, 'OPENAI_API_KEY_not_set' as reason,
  case when length(prompt) <= 600 then prompt else concat(substr(prompt, 1, 597), '...') end as prompt_preview,
  cast(0 as integer) as n_actions from p""",
    "insight_context": """
select event_id as seq,
  case when event_id % 4 = 0 then concat('restaurant_', cast(user_id % 5 as varchar))
       else 'restaurant_001' end as restaurant_id,
  case when event_id % 4 = 0 then concat('location_', cast(user_id % 3 as varchar))
       else 'location_001' end as location_id,
  cast(case event_id % 4 when 0 then 1 when 1 then 2 when 2 then 5 else 0 end as integer) as horizon,
  cast(case event_id % 4 when 0 then 1 when 1 then 2 else 0 end as integer) as n_forecast,
  case when event_id % 4 = 1 then '{"name":"m"}' else '{}' end as model_used,
  cast(case when event_id % 4 = 0 then 7 else 0 end as integer) as n_recent
from events""",
    "insight_answers": f"""
with a as (
  select event_id as seq, {_TENANT_OF_EVENT}, event_type,
    case when event_id % 11 = 0 then 'error' when event_id % 13 = 0 then 'skipped' else 'ok' end as status,
    case event_id % 5 when 0 then concat('{{"risk_level":"low","actions":["', event_type, '",2,"c"]}}')
      when 1 then concat('[', props, ']') when 2 then concat('!', props)
      when 3 then '{{"risk_level":null,"actions":"a"}}' else '{{}}' end as raw from events),
v as (select *, case when json_valid(raw) then cast(raw as json) end as j from a)
select seq, restaurant_id, location_id, status as insight_status, 'given' as model,
  case when status <> 'ok' then event_type end as reason,
  case when status = 'ok' then json_extract_string(j, '$.risk_level') end as risk_level,
  case when status = 'ok' and json_type(j, '$.actions') = 'ARRAY'
       then array_to_string([json_extract_string(x, '$') for x in cast(json_extract(j, '$.actions') as json[])], ',') else '' end as actions,
  case when status <> 'ok' or json_type(j) = 'OBJECT' then '' when j is null then 'json_parse_failed' else 'json_not_object' end as warning
from v""",
    "insight_parse": f"""with {_RUN_LOG}
select seq,
  case when not json_valid(payload_json) then 'json_parse_failed'
       when json_type(payload_json) <> 'OBJECT' then 'json_not_object' else 'ok' end as verdict,
  case when json_valid(payload_json) then json_extract_string(payload_json, '$.k') end as k
from run_log""",
    "run_summary": f"""with {_RUN_LOG}
select run_id, count(*) filter (where status = 'ok') as ok_count,
  count(*) filter (where status = 'error') as error_count,
  count(*) filter (where status = 'skipped') as skipped_count,
  bool_or(status = 'error') as has_errors, count(*) as steps_returned
from run_log group by 1""",
    "latest_run": f"""with {_RUN_LOG},
r as (
  select {_TENANT_OF_EVENT}, run_id, status, payload_json,
    row_number() over (partition by user_id % 5, user_id % 3 order by seq desc) as r from run_log)
select restaurant_id, location_id, run_id, status, json_valid(payload_json) as payload_ok from r where r = 1""",
    "latest_run_overall": f"""with {_RUN_LOG}
select {_TENANT_OF_EVENT}, run_id, status from run_log order by seq desc limit 1""",
    "run_tenants": """
select concat('run_', cast(event_id as varchar)) as run_id,
  case when event_id % 4 in (0, 1) then concat('restaurant_', cast(user_id % 5 as varchar))
       else 'restaurant_001' end as restaurant_id,
  case when event_id % 4 = 0 then concat('location_', cast(user_id % 3 as varchar))
       else 'location_001' end as location_id
from events""",
    "runs_of_one_tenant": f"""with {_RUN_LOG}
select seq, run_id, case when seq % 9 in (0, 1) then 'unknown' else status end as status,
  cast(case when seq % 4 = 0 then 0 else duration_ms end as bigint) as duration_ms
from run_log where user_id % 5 = 1 and user_id % 3 = 1 and seq % 5 <> 0""",
    "run_sales_extract": f"""with {_STORED},
whole as (
  select *, row_number() over (partition by seq order by i) as r from steps
  where len(list_filter(entries, lambda e: json_type(e) <> 'OBJECT')) = 0)
select run_id, {_ENTRY} from (select run_id, unnest(entries) as e from whole where r = 1)""",
    "latest_run_sales": f"""with {_STORED},
firsts as (
  select *, row_number() over (partition by seq order by i) as r from steps
  where seq = (select max(event_id) from events))
select restaurant_id, 'location_001' as location_id, {_ENTRY}
from (select restaurant_id, unnest(entries) as e from firsts where r = 1) where json_type(e) = 'OBJECT'""",
    "run_request_audit": f"""with {_AUDIT}
select request_id, array_to_string(plan, ',') as plan, array_to_string(bad_steps, ',') as unknown_steps,
  array_to_string(bad_selectors, ',') as unknown_selectors,
  case when strict and len(bad_steps) > 0 then 'unknown_steps' when refused then 'unknown_selectors'
       when len(bad_steps) > 0 or len(bad_selectors) > 0 then 'unknown_values_ignored'
       else 'ok' end as verdict,
  cast(len(plan) as integer) as steps_planned
from final""",
    "unknown_step_counts": f"""with {_REQUESTS},
asked as (select unnest({_list('steps')}) as step from run_requests)
select step, count(*) as requests from asked
where step not in (select event_type from events) group by 1""",
    "known_step_counts": f"""with {_REQUESTS},
asked as (select unnest({_list('steps')}) as step from run_requests)
select step, count(*) as requests from asked
where step in (select event_type from events) group by 1""",
    "step_durations": f"""with {_LINES},
p as (
  select regexp_extract(line, ' step=([^ ]*)', 1) as step,
         cast(regexp_extract(line, ' duration_ms=([^ ]*)', 1) as bigint) as ms from lines)
select step, count(*) as runs, avg(ms) as avg_ms, max(ms) as max_ms,
  round(quantile_cont(ms, 0.95), 6) as p95_ms from p group by 1""",
    "step_output_normalise": """
select event_id as step_id, case when event_type = 'error' then 'error' else 'ok' end as status,
  cast(event_type = 'error' as integer) as n_errors, cast(event_id % 10 = 0 as integer) as n_warnings,
  'ok' as demoted_status,
  cast(event_type = 'error' as integer) + cast(event_id % 10 = 0 as integer) as demoted_warnings
from events""",
    "step_payload_coerce": """with outputs as (
  select event_id as seq, case event_id % 8
    when 0 then concat('{"data":{"k":"', event_type, '"},"errors":[],"step":"s"}')
    when 1 then concat('{"errors":["', event_type, '",{"type":"E"}],"a":1,"status":"x"}')
    when 2 then concat('{"errors":"', event_type, '","warnings":["w",2],"metrics":{"rows":3}}')
    when 3 then concat('{"data":null,"errors":null,"b":["', event_type, '",null]}')
    when 4 then concat('["', event_type, '"]') when 5 then concat('!', event_type) when 6 then props
    else '{"data":7,"metrics":[1]}' end as raw from events),
j as (select seq, raw, case when json_valid(raw) then cast(raw as json) end as j from outputs),
typed as (select *, json_type(j) = 'OBJECT' as is_object, case when json_type(j) = 'OBJECT' then json_extract(j, '$.data') end as data,
    case when json_type(j) = 'OBJECT' then json_extract(j, '$.errors') end as e,
    case when json_type(j) = 'OBJECT' then json_extract(j, '$.warnings') end as w,
    case when json_type(j) = 'OBJECT' then json_extract(j, '$.metrics') end as m from j),
members as (select seq, string_agg(concat(to_json(k), ':', json_extract(j, concat('$.', k))), ',' order by k) as rest
  from (select seq, j, unnest(json_keys(j)) as k from typed where is_object)
  where k not in ('errors', 'warnings', 'metrics', 'status', 'step', 'data') group by seq),
counted as (select *,
    case when e is null or json_type(e) = 'NULL' then 0 when json_type(e) = 'ARRAY' then json_array_length(e) else 1 end as n_e,
    case when w is null or json_type(w) = 'NULL' then 0 when json_type(w) = 'ARRAY' then json_array_length(w) else 1 end as n_w from typed)
select seq, case when data is not null and json_type(data) <> 'NULL' then cast(data as varchar)
    when is_object then concat('{', coalesce(rest, ''), '}')
    when j is not null then concat('{"value":', cast(j as varchar), '}') else concat('{"value":', cast(to_json(raw) as varchar), '}') end as data_json,
  case when n_e = 0 then 'ok' else 'error' end as status, cast(n_e as integer) as n_errors, cast(n_w as integer) as n_warnings,
  case when json_type(m) = 'OBJECT' then cast(m as varchar) else '{}' end as metrics_json
from counted left join members using (seq)""",
    "dashboard_parts": f"""{_PLANNED},
parts as (
  select f.restaurant_id, f.location_id, f.day_index, length(f.location_id) % 2 = 1 as has_plan, ascii(f.location_id) % 2 = 1 as has_insight,
    case when length(f.restaurant_id) % 2 = 1 then cast(cast(round(avg4, 2) as decimal(18,2)) + f.day_index as decimal(18,2)) else predicted_sales end as predicted_sales
  from forecast f join avg_model using (restaurant_id, location_id)),
planned as (select restaurant_id, location_id, day_index, has_plan, has_insight, {_PLAN_COLUMNS} from parts)
select restaurant_id, location_id, day_index, predicted_sales,
  cast(case when has_plan then day_index + 10 else recommended_staff end as integer) as recommended_staff, ingredients_needed, estimated_meals,
  case when has_insight then 'ok' else 'skipped' end as insight_status, case when has_insight then 'high' end as risk_level,
  cast(case when has_insight then 2 else 0 end as integer) as n_actions
from planned""",
    "file_models": f"""with {_SALES},
of_file as (
  select case when length(restaurant_id) % 2 = 1 then concat(replace(restaurant_id, ' ', '_'), '__sales.csv') else 'upload_sales.csv' end as file_name,
    restaurant_id, location_id, date, daily_sales_total from sales),
days as (
  select case when length(restaurant_id) % 2 = 1 then concat(restaurant_id, '__sales.csv') else 'upload_sales.csv' end as file_name, date,
    sum(daily_sales_total) as total from sales group by 1, 2),
named as (select distinct n_name as restaurant_id, c_mktsegment as location_id, replace(n_name, ' ', '_') as safe from customer join nation on c_nationkey = n_nationkey),
chosen as (select restaurant_id, location_id, case when concat(safe, '__sales.csv') in (select file_name from days) then concat(safe, '__sales.csv')
    else 'upload_sales.csv' end as file_name from named),
points as (select file_name, cast(total as double) as y, total, row_number() over (partition by file_name order by date) - 1 as x from days),
fits as (select file_name, count(*) as n, sum(cast(total * 10000 as hugeint)) as s, coalesce(regr_slope(y, x), 0) as slope, coalesce(regr_intercept(y, x), avg(y)) as intercept
  from points group by 1)
select restaurant_id, location_id, file_name, cast(cast((2 * s + n) // (2 * n) as decimal(22,0)) * cast(0.0001 as decimal(5,4)) as double) as avg_daily_sales,
  n as training_rows, round(slope, 4) as slope, round(intercept, 4) as intercept
from chosen left join fits using (file_name)""",
    "stored_run_average": f"""with {_STORED},
whole as (
  select *, row_number() over (partition by seq order by i) as r from steps
  where len(list_filter(entries, lambda e: json_type(e) <> 'OBJECT')) = 0),
firsts as (select seq, any_value(restaurant_id order by i) as restaurant_id from steps group by seq),
usable as (select seq, restaurant_id, e from (select seq, unnest(entries) as e from whole where r = 1) join firsts using (seq)),
priced as (select seq, restaurant_id, {_ENTRY} from usable),
newest as (select restaurant_id, max(seq) as seq from priced where daily_sales_total is not null group by 1),
sales as (select p.restaurant_id, 'location_001' as location_id, cast(daily_sales_total as decimal(18,2)) as daily_sales_total
  from priced p join newest using (restaurant_id, seq) where daily_sales_total is not null),
{_average('sales')}
select restaurant_id, location_id, cast(avg4 as double) as avg_daily_sales, training_rows from avg_model""",
    "stored_run_trend": f"""with {_STORED},
firsts as (select *, row_number() over (partition by seq order by i) as r from steps),
entries_ as (select seq, restaurant_id, unnest(range(1, len(entries) + 1)) as place, entries as l from firsts where r = 1),
priced as (select seq, restaurant_id, place, {_ENTRY} from (select seq, restaurant_id, place, l[place] as e from entries_) where json_type(e) = 'OBJECT'),
newest as (select restaurant_id, max(seq) as seq from priced where daily_sales_total is not null group by 1),
points as (select restaurant_id, daily_sales_total as y, row_number() over (partition by restaurant_id order by date, place) - 1 as x
  from priced join newest using (restaurant_id, seq) where daily_sales_total is not null),
fits as (select restaurant_id, count(*) as n, case when count(*) > 1 then regr_slope(y, x) else 0 end as slope, case when count(*) > 1 then regr_intercept(y, x) else avg(y) end as intercept from points group by 1)
select restaurant_id, 'location_001' as location_id, round(any_value(intercept), 4) as intercept, round(any_value(slope), 4) as slope,
  round(stddev_pop(y - (intercept + slope * x)), 4) as std_error, any_value(n) as rows
from points join fits using (restaurant_id) group by 1""",
}
