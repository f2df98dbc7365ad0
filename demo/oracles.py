"""SQL with the same answers as the registered queries.

Written for a plain SQL engine, straight from the definitions: series as date
grid and outer join, summaries on the full grid.
"""

from __future__ import annotations

from demo.settings import (
    ASN,
    ASNS,
    COUNTRIES,
    COUNTRY,
    DAY,
    END,
    HIDDEN,
    IP,
    NEXT_DAY,
    SEARCHES,
    START,
    USERNAME,
    WIDE_END,
    WIDE_START,
)

K = "cast(json_extract_string(e.props, '$.k') as bigint)"

BASE = f"""
ip_lookup as (
  select concat('10.0.', cast(floor(s.s_suppkey / 256) as int), '.', cast(s.s_suppkey % 256 as int)) as ip,
         r.r_name as continent, concat('C', cast(n.n_nationkey as varchar)) as country_code,
         n.n_name as country,
         cast(n.n_nationkey * 5 - 60 as double) as latitude,
         cast(n.n_nationkey * 10 - 120 as double) as longitude,
         concat('AS', cast(s.s_suppkey % 7 as varchar)) as asn,
         concat('NET_', cast(s.s_suppkey % 7 as varchar)) as asn_name,
         concat('net', cast(s.s_suppkey % 7 as varchar), '.example') as asn_domain,
         case when s.s_suppkey % 3 = 0 then 'isp' when s.s_suppkey % 3 = 1 then 'hosting'
              else 'business' end as asn_type
  from supplier s
  join nation n on s.s_nationkey = n.n_nationkey
  join region r on n.n_regionkey = r.r_regionkey
),
raw_log as (
  select e.ts as datetime, cast(e.ts as date) as date,
         concat('10.0.', cast(floor(e.user_id / 256) as int), '.', cast(e.user_id % 256 as int)) as ip,
         cast(extract(hour from e.ts) * 10000 + extract(minute from e.ts) * 100 as bigint) as time,
         concat('node_', cast(e.user_id % 3 as varchar)) as node,
         cast(case when {K} < 60 then 22 else 2222 end as bigint) as port,
         cast(e.event_id as varchar) as pid,
         concat(e.event_type, '_', cast({K} % 8 as varchar)) as username,
         e.event_type as tag
  from events e
),
attacks as (select l.*, k.* exclude (ip) from raw_log l left join ip_lookup k on l.ip = k.ip),
daily_stats as (
  select date, count(*) as total_attacks, count(distinct ip) as unique_ips,
         count(distinct country) as unique_countries, count(distinct username) as unique_usernames
  from attacks group by date
),
daily_country as (
  select date, country, count(*) as attacks from attacks where country is not null group by all
),
daily_asn as (
  select date, asn, asn_name, country, count(*) as attacks from attacks
  where asn_name is not null and asn_name <> 'Unknown' and country is not null and country <> ''
  group by all
),
daily_username as (
  select date, username, country, asn_name, count(*) as attacks from attacks
  where country is not null and country <> '' and asn_name is not null and asn_name <> ''
  group by all
),
daily_ip as (select date, ip, country, asn_name, count(*) as attacks from attacks group by all),
daily_ip_username as (
  select date, ip, username, country, asn_name, count(*) as attacks from attacks group by all
),
dates as (
  select cast(unnest(generate_series(date '{START}', date '{END}', interval 1 day)) as date) as date
)"""

RANGE = f"date between date '{START}' and date '{END}'"


# The long log in place of the first one: same columns as far as they are used.
WIDE_LOG = """
ip_lookup as (
  select concat('10.1.', cast(floor(s.s_suppkey / 256) as int), '.', cast(s.s_suppkey % 256 as int)) as ip,
         n.n_name as country, concat('AS', cast(s.s_suppkey % 7 as varchar)) as asn,
         concat('NET_', cast(s.s_suppkey % 7 as varchar)) as asn_name
  from supplier s join nation n on s.s_nationkey = n.n_nationkey
),
raw_log as (
  select l_shipdate as datetime, cast(l_shipdate as date) as date,
         concat('10.1.', cast(floor(l_suppkey / 256) as int), '.', cast(l_suppkey % 256 as int)) as ip,
         concat(l_returnflag, l_linestatus) as username
  from lineitem
),"""


def wide(sql: str) -> str:
    """The same SQL over the long log and its period."""
    tables = BASE[BASE.index("attacks as (") :].strip()
    return (
        sql.replace(BASE.strip(), (WIDE_LOG + tables).strip())
        .replace(START, WIDE_START)
        .replace(END, WIDE_END)
    )


def q(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([BASE.strip(), *ctes]) + "\n" + body


def rnd(x: str, digits: int = 2) -> str:
    scale = 10**digits
    return f"sign({x}) * floor(abs({x}) * {scale}e0 + 0.5e0) / {scale}e0"


def line(table: str, where: str, extra: str = "") -> str:
    """One filled line."""
    return q(f"""
select cast(d.date as varchar) as date{extra}, cast(coalesce(sum(t.attacks), 0) as bigint) as attacks
from dates d left join daily_{table} t on d.date = t.date and {where}
group by d.date""")


def grid(table: str, entity: str, where: str, label: str | None = None, n: int = 10,
         given: list[str] | None = None, pool: str | None = None) -> str:
    """Filled lines of the largest or the given entities."""
    return q(*reversed(grid_parts(table, entity, where, label, n, given, pool)))


def grid_parts(table, entity, where, label=None, n=10, given=None, pool=None):
    if given is not None:
        chosen = f"chosen as (select unnest({list(given)}) as {entity})"
    else:
        chosen = f"""chosen as (
  select {entity} from {pool or 'daily_' + table} t where {RANGE} and {where} and {entity} is not null
  group by {entity} order by sum(attacks) desc, {entity} limit {n})"""
    shown = f", {label} as country" if label else ""
    body = f"""
select cast(g.date as varchar) as date, g.{entity}{shown},
       cast(coalesce(sum(t.attacks), 0) as bigint) as attacks
from (select d.date, c.{entity} from dates d cross join chosen c) g
left join daily_{table} t on g.date = t.date and g.{entity} = t.{entity} and {where}
group by g.date, g.{entity}"""
    return chosen, body


U = f"t.username = '{USERNAME}'"
C = f"t.country = '{COUNTRY}'"
A = f"t.asn_name = '{ASN}'"
I = f"t.ip = '{IP}'"
CS = f"t.country in {COUNTRIES!r}"


def max_label(default: str) -> str:
    return f"coalesce(max(t.country), '{default}')"


HOME = f"home as (select min(country) as country from daily_ip where ip = '{IP}' having count(*) > 0)"

PCT = "case when {p} > 0 then ({a} - {p}) * 100.0e0 / {p} else 0.0e0 end"


def volatility(dim: str, table: str, where: str = "true") -> str:
    return q("""
select """ + dim + """, max_volatility, cast(max_change_date as varchar) as max_change_date,
       attacks_on_max, prev_attacks_on_max
from (
  select *, row_number() over (partition by """ + dim + """ order by abs(pct) desc, date) as place,
         max(abs(pct)) over (partition by """ + dim + """) as max_volatility,
         date as max_change_date, attacks as attacks_on_max, prev as prev_attacks_on_max
  from changes)
where place = 1""", *change_ctes(dim, table, where))


def change_ctes(dim: str, table: str, where: str) -> tuple[str, ...]:
    return (
        f"""days as (
  select {dim}, date, cast(sum(attacks) as bigint) as attacks from daily_{table} t
  where {where} and {dim} is not null group by {dim}, date)""",
        f"""lagged as (
  select *, lag(attacks) over (partition by {dim} order by date) as prev from days)""",
        f"""changes as (
  select *, {PCT.format(a='attacks', p='prev')} as pct from lagged where prev is not null)""",
    )


def unusual(dim: str, table: str, where: str, pick_where: str | None = None) -> str:
    """Filled lines of the entities with the greatest change between present days."""
    pick = f"{RANGE} and {pick_where or where}"
    return q(f"""
select cast(date as varchar) as date, {dim}, coalesce(attacks, 0) as attacks,
       {rnd(PCT.format(a='coalesce(attacks, 0)', p='prev'))} as pct_change
from (select *, lag(attacks) over (partition by {dim} order by date) as prev from filled)""",
             *change_ctes(dim, table, pick),
             f"""chosen as (
  select {dim} from changes group by {dim} order by max(abs(pct)) desc, {dim} limit 10)""",
             f"""filled as (
  select g.date, g.{dim}, cast(sum(t.attacks) as bigint) as attacks
  from (select d.date, c.{dim} from dates d cross join chosen c) g
  left join daily_{table} t on g.date = t.date and g.{dim} = t.{dim} and {where}
  group by g.date, g.{dim})""")


def unusual_line(table: str, where: str) -> str:
    return q(f"""
select cast(date as varchar) as date, '{COUNTRY}' as country, coalesce(attacks, 0) as attacks,
       {rnd(PCT.format(a='coalesce(attacks, 0)', p='prev'))} as pct_change
from (select *, lag(attacks) over (order by date) as prev from filled)""",
             f"""filled as (
  select d.date, cast(sum(t.attacks) as bigint) as attacks
  from dates d left join daily_{table} t on d.date = t.date and {where} group by d.date)""")


SUMMARY_COLUMNS = f"""s.total_attacks, {rnd('s.avg_daily')} as avg_daily,
       cast(s.first_seen as varchar) as first_seen, cast(s.last_seen as varchar) as last_seen,
       s.max_daily, coalesce(v.max_absolute_change, 0) as max_absolute_change,
       coalesce({rnd('v.max_pct_change')}, 0.0e0) as max_pct_change,
       {rnd(f"100.0e0 * s.active_days / (date_diff('day', date '{START}', date '{END}') + 1)", 1)}
         as persistence_pct,
       coalesce(r.recent_attacks, 0) as recent_attacks, s.active_days"""

CHANGE_FROM_ONE = """case when prev = 0 then (attacks - 1.0e0) * 100.0e0
       else (attacks - prev) / cast(prev as double) * 100.0e0 end"""


def change_metrics(entity: str, source: str) -> str:
    return f"""moves as (
  select {entity}, max(attacks - prev) as max_absolute_change, max({CHANGE_FROM_ONE}) as max_pct_change
  from (select *, lag(attacks) over (partition by {entity} order by date) as prev from {source})
  where prev is not null group by {entity})"""


def stats_of(entity: str, source: str) -> str:
    return f"""stats as (
  select {entity}, cast(sum(attacks) as bigint) as total_attacks, avg(attacks) as avg_daily,
         count(*) as active_days, min(date) as first_seen, max(date) as last_seen,
         max(attacks) as max_daily
  from {source} group by {entity})"""


def grid_summary(entity: str, table: str, extra: str = "", extra_join: str = "") -> str:
    return q(f"""
select s.{entity}, {SUMMARY_COLUMNS}{extra}
from stats s left join moves v on s.{entity} = v.{entity}
left join recent r on s.{entity} = r.{entity} {extra_join}""",
             f"""present as (
  select {entity}, date, cast(sum(attacks) as bigint) as attacks from daily_{table}
  where {RANGE} and {entity} <> 'Unknown' group by {entity}, date)""",
             f"""full_grid as (
  select d.date, l.{entity}, coalesce(p.attacks, 0) as attacks
  from dates d cross join (select distinct {entity} from present) l
  left join present p on d.date = p.date and l.{entity} = p.{entity})""",
             stats_of(entity, "present"), change_metrics(entity, "full_grid"),
             f"""recent as (
  select {entity}, cast(sum(attacks) as bigint) as recent_attacks from full_grid
  where date > date '{END}' - interval 7 day group by {entity})""",
             f"""partners as (
  select {entity}, count(distinct country) as countries from daily_{table}
  where {RANGE} group by {entity})""")


def present_summary(entity: str, table: str, extra: str, labels: str) -> str:
    return q(f"""
select s.{entity}, {SUMMARY_COLUMNS}, {extra}
from stats s left join moves v on s.{entity} = v.{entity}
left join recent r on s.{entity} = r.{entity} left join labels x on s.{entity} = x.{entity}""",
             f"""chosen as (
  select distinct {entity} from daily_{table} where {RANGE})""",
             f"""present as (
  select {entity}, date, cast(sum(attacks) as bigint) as attacks from daily_{table}
  where {RANGE} and {entity} in (select {entity} from chosen) group by {entity}, date)""",
             stats_of(entity, "present"), change_metrics(entity, "present"),
             f"""recent as (
  select {entity}, cast(sum(attacks) as bigint) as recent_attacks from daily_{table}
  where date between date '{END}' - interval 6 day and date '{END}' group by {entity})""",
             f"labels as (select {entity}, {labels} from daily_{table} where {RANGE} group by {entity})")


def mode_of(column: str) -> str:
    """Most frequent value of a column per ip; the smallest of equals."""
    return f"""(select m.{column} from (
      select ip, {column}, count(*) as n from daily_ip where {RANGE} and {column} is not null
      group by ip, {column}) m where m.ip = daily_ip.ip order by m.n desc, m.{column} limit 1)"""


def country_numbers() -> str:
    """The country summary as a CTE list, to be ranked."""
    return grid_summary("country", "country")


def top(entity: str, table: str, n: int = 10) -> str:
    return q(f"""
select {entity}, cast(sum(attacks) as bigint) as attacks from daily_{table}
where {RANGE} and {entity} is not null group by {entity} order by attacks desc, {entity} limit {n}""")


def partners(table: str, entity: str, partner: str) -> str:
    return q(f"""
select {entity}, count(distinct {partner}) as partners from daily_{table}
where {RANGE} and {entity} is not null group by {entity}""")


def reconcile(table: str) -> str:
    return f"""
select 'daily_{table}' as rollup, expected, actual, abs(expected - actual) as difference,
       {rnd('100.0e0 * abs(expected - actual) / expected')} as difference_pct,
       case when abs(expected - actual) < 1000 then 'match'
            when 100.0e0 * abs(expected - actual) / expected < 1 then 'close'
            else 'different' end as verdict
from (select cast(sum(total_attacks) as bigint) as expected from daily_stats),
     (select cast(sum(attacks) as bigint) as actual from daily_{table})"""


RANKED = """select *, (rank_total_attacks + rank_max_pct_change + rank_first_seen) / 3.0e0 as avg_rank
from (select *,
        rank() over (order by total_attacks desc) as rank_total_attacks,
        rank() over (order by max_pct_change desc) as rank_max_pct_change,
        rank() over (order by first_seen) as rank_first_seen
      from ({numbers}))"""

RAW_TEXT = f"""
raw_text as (
  select e.event_id as number, e.ts, cast(e.event_id as varchar) as pid,
         case when e.event_id % 17 = 0 or e.event_id % 19 = 0 then null else cast(e.ts as date) end as day,
         case when e.event_id % 5 = 0 then 0 else extract(hour from e.ts) end as hour_or_zero,
         case when e.event_id % 7 = 0 then 0 when e.event_id % 11 = 0 then 22 else {K} end as port,
         case when e.event_id % 13 = 0 or e.event_id % 23 = 0 or e.event_id % 29 = 0 then 'nan'
              else e.event_type end as username
  from events e)"""

PROFILE_COLUMNS = {"ip": "string", "node": "string", "port": "bigint", "username": "string",
                   "tag": "string"}


TEN = """total_attacks, avg_daily, first_seen, last_seen, max_daily, max_absolute_change, max_pct_change,
       persistence_pct, recent_attacks, active_days"""


def ten(numbers: str, entity: str) -> str:
    """The metrics that blocks of days give, out of a whole summary."""
    return f"select {entity}, {TEN} from ({numbers})"


def stored_answers(answers: dict[str, str]) -> dict[str, str]:
    """SQL of the queries on stored sets, posting lists and blocks of days."""
    first, second = (f"date between date '{a}' and date '{b}'" for a, b in ((START, DAY), (NEXT_DAY, END)))
    texts = ", ".join(f"'{text}'" for text in SEARCHES)
    days = change_ctes("country", "country", f"country <> 'Unknown' and {RANGE}")
    return {
        "unique_entities": answers["entity_counts"],
        "unique_ips_by_week": q("""
select cast(cast(date_trunc('week', date) as date) as varchar) as period, count(distinct ip) as entities
from daily_ip group by 1"""),
        "unique_ips_by_country": q(f"""
select country, count(distinct ip) as entities from daily_ip where {RANGE} group by country"""),
        "returning_ips": q("""
select country, count(*) filter (in_a and in_b) as both, count(*) filter (in_a and not in_b) as only_first,
       count(*) filter (in_b and not in_a) as only_second from seen group by country""", f"""
seen as (select country, ip, bool_or({first}) as in_a, bool_or({second}) as in_b from daily_ip
  where {RANGE} group by country, ip)"""),
        "overlap_estimate": q("""
select country, count(*) filter (in_a and in_b) as both, count(*) filter (in_a and not in_b) as only_first,
       count(*) filter (in_b and not in_a) as only_second from seen group by country""", f"""
seen as (select country, ip, bool_or({first}) as in_a, bool_or({second}) as in_b from daily_ip
  where {RANGE} group by country, ip)"""),
        "name_search": q(f"""
select text, name from (select unnest([{texts}]) as text) join names on contains(lower(name), lower(text))""", """
names as (select distinct ip as name from daily_ip union all select distinct username from daily_username)"""),
        "heavy_ips": q("""
select ip, count(*) as attacks from raw_log group by ip order by attacks desc, ip limit 20"""),
        **{
            f"heavy_{name}_range": q(f"""
select {column}, count(*) as attacks from raw_log where {RANGE} group by {column}
order by attacks desc, {column} limit 10""")
            for name, column in (("ips", "ip"), ("usernames", "username"))
        },
        "overlap_of_countries": q(f"""
select count(*) filter (in_a and in_b) as both, count(*) filter (in_a and not in_b) as only_first,
       count(*) filter (in_b and not in_a) as only_second, count(*) filter (in_a or in_b) as either
from (select ip, bool_or({first} and country in {COUNTRIES!r}) as in_a, bool_or({second}) as in_b
      from daily_ip where {RANGE} group by ip)"""),
        "differing_rows": q(f"""
select cast(date as varchar) as date, ip, country, attacks, 'only_first' as side from daily_ip
  where ip = '{IP}' and day(date) in (5, 17) or ip = '10.0.0.7' and date = date '{DAY}'
union all select cast(date as varchar), ip, country, attacks + 3, 'only_second' from daily_ip
  where ip = '{IP}' and day(date) in (5, 17)
union all select cast(date as varchar), 'planted', country, attacks, 'only_second' from daily_ip
  where ip = '{IP}' and date = date '{DAY}'"""),
        "threshold_top_ips": answers["top_ips_range"],
        "wide_threshold_top_ips": wide(answers["top_ips_range"]),
        "union_of_drifting_types": """
select case when user_id % 4 = 1 then event_id + 0.5e0 else event_id::double end as event_id,
       case when user_id % 4 = 2 then 'u' else '' end || user_id::varchar as user_id,
       case user_id % 4 when 1 then ts::timestamp when 3 then null else date_trunc('day', ts)::timestamp end as ts,
       case user_id % 4 when 2 then event_type when 3 then (event_id % 2 = 0)::varchar end as event_type
from events""",
        "drifting_types": """
select 'event_id' as "column", 'bigint,double,int' as types, 'double' as chosen, count(event_id) as filled from events
union all select 'user_id', 'bigint,double,smallint,string', 'string', count(user_id) from events
union all select 'ts', 'date,timestamp_ntz', 'timestamp_ntz', count(ts) filter (user_id % 4 < 3) from events
union all select 'event_type', 'boolean,string', 'string', count(event_type) filter (user_id % 4 >= 2) from events""",
        "ingest_csv": answers["ingest_normalise"],
        **dict.fromkeys(("lookup_json", "lookup_json_lines"), q("""
select * replace (case when asn = 'AS3' then null else latitude end as latitude) from ip_lookup""")),
        "lake_range": "with " + RAW_TEXT + f"""
select pid, cast(day as timestamp) as datetime, cast(year(day) as int) as year, cast(month(day) as int) as month
from raw_text where day between date '{START}' and date '{END}'""",
        "lake_files": "with " + RAW_TEXT + """
select cast(year(day) as int) as year, cast(month(day) as int) as month, 1::bigint as files, count(*) as rows
from raw_text where day is not null group by 1, 2""",
        "stored_tables": " union all ".join(
            f"select '{name}' as name, count(*) as rows, cast(sum({column}) as bigint) as total from ({answers[key]})"
            for name, key, column in (
                ("country_stats", "country_stats", "total_attacks"),
                ("top_ips", "top_ips", "unique_usernames"),
                ("username_stats", "username_stats", "unique_ips"),
                ("hourly_patterns", "hourly_patterns", "unique_ips"),
                ("daily_country", "daily_country", "attacks"),
                ("daily_ip_username", "daily_ip_username", "attacks"),
                ("volatile_ip_summary", "volatile_ip", "attacks_on_max"),
            )
        ),
        "ingest_report": "with " + RAW_TEXT + """
select strftime(day, '%Y-%m') as part, count(*) as rows from raw_text where day is not null group by 1
union all select 'all', count(*) from raw_text
union all select 'undated', count(*) - count(day) from raw_text
union all select 'rejected', count(*) - count(day) from raw_text
union all select concat('first ', min(day), ' 00:00:00'), 1 from raw_text
union all select concat('last ', max(day), ' 00:00:00'), 1 from raw_text""",
        **{
            f"blocks_{dim}_summary": ten(answers[f"{dim}_summary"], entity)
            for dim, entity in (("country", "country"), ("asn", "asn_name"), ("ip", "ip"), ("username", "username"))
        },
        "blocks_volatile_ip": answers["volatile_ip"],
        "blocks_volatile_country_range": answers["volatile_country"].replace(
            change_ctes("country", "country", "country <> 'Unknown'")[0], days[0]
        ),
        "blocks_country_volatility": answers["country_volatility"],
        "wide_blocks_country_summary": ten(answers["wide_country_summary"], "country"),
        "wide_blocks_ip_summary": ten(answers["wide_ip_summary"], "ip"),
    }


WIDE_KEYS = (
    "daily_stats",
    "daily_ip",
    "total_series",
    "country_series",
    "ip_series",
    "username_series",
    "asn_series",
    "volatile_ip",
    "unusual_countries",
    "country_summary",
    "asn_summary",
    "ip_summary",
    "username_summary",
    "volume_vs_volatility",
)


def oracle_sql() -> dict[str, str]:
    numbers = country_numbers()
    ranked = RANKED.format(numbers=numbers)
    series_of_countries = grid("country", "country", "true")
    union_top = " union all ".join(
        f"""select * from (
  select '{c}' as "column", cast({c} as varchar) as value, count(*) as rows,
         row_number() over (order by count(*) desc, cast({c} as varchar)) as place
  from raw_log group by 2) where place <= 5"""
        for c in PROFILE_COLUMNS
    )
    page = f"""
select *, position from (
  select *, row_number() over (order by total_attacks desc, ip) as position
  from ({{numbers}})) where position between 26 and 50"""
    ip_numbers = present_summary(
        "ip", "ip", "x.country, x.asn_name",
        f"{mode_of('country')} as country, {mode_of('asn_name')} as asn_name")
    username_numbers = present_summary(
        "username", "username", "x.countries", "count(distinct country) as countries")

    answers = {
        # sources and ingest
        "ingest_normalise": "with " + RAW_TEXT + """
select pid, cast(day as timestamp) as datetime, cast(year(day) as int) as year,
       cast(month(day) as int) as month, cast(hour_or_zero as bigint) as time,
       cast(port as bigint) as port, username from raw_text""",
        "enrich_left": q("""
select pid, ip, continent, country_code, country, latitude, longitude, asn, asn_name, asn_domain,
       asn_type from attacks"""),
        "enrich_heavy_keys": q("select pid, ip, country, asn_name from attacks"),
        "ingest_daily_country": q("""
select cast(r.day as varchar) as date, k.country, count(*) as attacks
from raw_text r join events e on r.number = e.event_id
join ip_lookup k on k.ip = concat('10.0.', cast(floor(e.user_id / 256) as int), '.', cast(e.user_id % 256 as int))
where r.day is not null group by r.day, k.country""", RAW_TEXT.strip()),
        "ingest_undated": "with " + RAW_TEXT + """
select count(*) as rows, count(*) - count(day) as undated_rows from raw_text""",
        "ingest_partition_counts": "with " + RAW_TEXT + """
select cast(year(day) as int) as year, cast(month(day) as int) as month, count(*) as rows
from raw_text where day is not null group by 1, 2""",
        "safe_number": "with " + RAW_TEXT + f"""
select r.pid,
       case when r.number % 3 = 0 or r.number % 7 = 1 then null
            else cast(concat(cast(r.number % 180 - 90 as varchar), '.25') as double) end as latitude,
       case when r.number % 7 = 0 then null when r.number % 11 = 0 then 22.7e0
            else cast({K} as double) end as port,
       case when r.number % 5 = 0 then null else extract(hour from r.ts) + 0.5e0 end as time
from raw_text r join events e on r.number = e.event_id""",
        "attacks_columns": q("""
select cast(r.day as timestamp) as datetime, cast(year(r.day) as int) as year,
       cast(month(r.day) as int) as month,
       concat('10.0.', cast(floor(e.user_id / 256) as int), '.', cast(e.user_id % 256 as int)) as "IP",
       cast(r.hour_or_zero as bigint) as "Time",
       k.continent, k.country_code, k.country, k.latitude, k.longitude,
       k.asn, k.asn_name, k.asn_domain, k.asn_type,
       concat('node_', cast(e.user_id % 3 as varchar)) as "Node", cast(r.port as bigint) as "Port",
       r.pid as "PID", r.username as "Username", e.event_type as "Tag",
       cast(e.props as varchar) as "Message"
from raw_text r join events e on r.number = e.event_id
left join ip_lookup k
  on k.ip = concat('10.0.', cast(floor(e.user_id / 256) as int), '.', cast(e.user_id % 256 as int))""",
            RAW_TEXT.strip()),
        "union_by_name": """
select doc_id, lang, source, n_chars, null as quality, null as toxic from documents
union all select doc_id, null, null, null, quality, toxic from labels""",
        "file_rows": """
select 'documents.parquet' as file, count(*) as rows from documents
union all select 'labels.parquet', count(*) from labels""",
        "coverage_by_file": " union all ".join(
            f"""select '{t}.parquet' as file, '{c}' as "column", count(*) as rows,
  count({x}) as filled, {rnd(f'100.0e0 * count({x}) / count(*)', 1)} as filled_pct,
  cast(100.0e0 * count({x}) / count(*) > 90 as int) as enough from {t}"""
            for t, own in (("documents", ("doc_id", "lang")), ("labels", ("doc_id", "quality")))
            for c in ("doc_id", "lang", "quality")
            for x in [c if c in own else "null"]),
        "profile_log": q(" union all ".join(
            f"""select '{c}' as "column", '{t}' as type, count(*) as rows, count({c}) as filled,
  count(distinct {c}) as distinct_values, min(cast({c} as varchar)) as least,
  max(cast({c} as varchar)) as greatest from raw_log""" for c, t in PROFILE_COLUMNS.items())),
        "profile_top_values": q(union_top),
        # rollups
        **dict.fromkeys(("daily_base", "daily_base_from_log"), q("""
select cast(date as varchar) as date, ip, username, country, asn, asn_name, count(*) as attacks
from attacks group by all""")),
        "daily_stats_from_base": q("select * replace (cast(date as varchar) as date) from daily_stats"),
        "daily_stats": q("select * replace (cast(date as varchar) as date) from daily_stats"),
        "country_stats": q("""
select country, min(country_code) as country_code, min(continent) as continent,
       count(*) as total_attacks, count(distinct ip) as unique_ips,
       count(distinct username) as unique_usernames, min(datetime) as first_seen,
       max(datetime) as last_seen, avg(latitude) as avg_latitude, avg(longitude) as avg_longitude
from attacks where country is not null group by country"""),
        "top_ips": q("""
select ip, min(coalesce(country, 'Unknown')) as country, min(coalesce(asn, 'Unknown')) as asn,
       min(coalesce(asn_name, 'Unknown')) as asn_name, count(*) as attack_count,
       count(distinct username) as unique_usernames, min(datetime) as first_seen,
       max(datetime) as last_seen
from attacks group by ip order by attack_count desc, ip limit 10000"""),
        "username_stats": q("""
select username, count(*) as attempt_count, count(distinct ip) as unique_ips,
       count(distinct country) as unique_countries, min(datetime) as first_seen,
       max(datetime) as last_seen
from attacks group by username order by attempt_count desc, username limit 10000"""),
        "hourly_patterns": q("""
select cast(extract(hour from datetime) as bigint) as hour, count(*) as attack_count,
       count(distinct ip) as unique_ips from raw_log group by 1"""),
        **{
            f"daily_{t}": q(f"select * replace (cast(date as varchar) as date) from daily_{t}")
            for t in ("country", "asn", "username", "ip", "ip_username")
        },
        "rollup_merge": q("""
select cast(date as varchar) as date, country, count(*) as attacks from attacks
where country is not null group by date, country"""),
        "rollup_duplicates": q("""
select cast(date as varchar) as date, count(*) as rows_before,
       count(distinct (ip, username, coalesce(country, ''), coalesce(asn_name, ''))) as rows_after,
       count(*) - count(distinct (ip, username, coalesce(country, ''), coalesce(asn_name, '')))
         as duplicates_removed
from (select distinct date, node, port, ip, username, country, asn_name from attacks) group by date"""),
        "date_range": q("""
select cast(min(date) as varchar) as min_date, cast(max(date) as varchar) as max_date from daily_stats"""),
        "entity_counts": q(" union all ".join(
            f"select '{d}' as dimension, count(distinct {e}) as entities from daily_{d} where {RANGE}"
            for d, e in (("country", "country"), ("asn", "asn_name"), ("ip", "ip"),
                         ("username", "username")))),
        "countries_per_ip": partners("ip", "ip", "country"),
        "countries_per_asn": partners("asn", "asn_name", "country"),
        "asns_per_ip": partners("ip", "ip", "asn_name"),
        "asns_per_country": partners("asn", "country", "asn_name"),
        "top_countries": top("country", "country"),
        "top_ips_range": top("ip", "ip"),
        "top_usernames": top("username", "username"),
        "top_asns": top("asn_name", "asn"),
        # series: total
        "total_series_username": line("ip_username", U),
        "total_series_username_all": line("ip_username", f"{U} and {I} and {C} and {A}"),
        "total_series_ip": line("ip", I),
        "total_series_asn_country": line("asn", f"{A} and {C}"),
        "total_series_country": q(f"""
select cast(date as varchar) as date, attacks from daily_country t where {RANGE} and {C}"""),
        "total_series_asn": line("asn", A),
        "total_series": q(f"""
select cast(date as varchar) as date, total_attacks as attacks from daily_stats where {RANGE}"""),
        # series: country
        "country_series_username_country": line("ip_username", f"{U} and {C}", f", '{COUNTRY}' as country"),
        "country_series_username": grid("ip_username", "country", U),
        "country_series_username_asn": grid("ip_username", "country", f"{U} and {A}"),
        "country_series_ip": q(f"""
select cast(d.date as varchar) as date, coalesce(t.country, h.country) as country,
       coalesce(t.attacks, 0) as attacks
from dates d cross join home h left join daily_ip t on d.date = t.date and {I}""", HOME),
        "country_series_asn_country": line("asn", f"{A} and {C}", f", '{COUNTRY}' as country"),
        "country_series_country": q(f"""
select cast(date as varchar) as date, country, attacks from daily_country t where {RANGE} and {C}"""),
        "country_series_asn": grid("asn", "country", A),
        "country_series": series_of_countries,
        # series: ip
        "ip_series_username_ip": line(
            "ip_username", f"{U} and {I}", f", '{IP}' as ip, {max_label('Unknown')} as country"),
        "ip_series_username": grid("ip_username", "ip", U, max_label("Mixed")),
        "ip_series_username_country_asn": grid(
            "ip_username", "ip", f"{U} and {C} and {A}", max_label("Mixed")),
        "ip_series_ip": line("ip", I, f", '{IP}' as ip, {max_label('Unknown')} as country"),
        "ip_series_asn_country": grid("ip", "ip", f"{A} and {C}", max_label(COUNTRY)),
        "ip_series_country": grid("ip", "ip", C, max_label(COUNTRY)),
        "ip_series_asn": grid("ip", "ip", A, max_label("Mixed")),
        "ip_series": grid("ip", "ip", "true", max_label("Mixed")),
        # series: username
        "username_series_username": line(
            "ip_username", U, f", '{USERNAME}' as username, {max_label('Mixed')} as country"),
        "username_series_username_all": line(
            "ip_username", f"{U} and {I} and {C} and {A}",
            f", '{USERNAME}' as username, {max_label('Mixed')} as country"),
        "username_series_ip": grid("ip_username", "username", I, "'Single IP'"),
        "username_series_asn_country": grid("username", "username", f"{A} and {C}", f"'{COUNTRY}'"),
        "username_series_country": grid("username", "username", C, f"'{COUNTRY}'"),
        "username_series_asn": grid("username", "username", A, "'Mixed'"),
        "username_series": grid("username", "username", "true", "'Mixed'"),
        # series: asn
        "asn_series_asn": grid("asn", "asn_name", "true", max_label("Mixed"), given=[ASN]),
        "asn_series_asns_list": grid("asn", "asn_name", C, max_label("Mixed"), given=ASNS),
        "asn_series": grid("asn", "asn_name", "true", max_label("Mixed")),
        "asn_series_country": grid("asn", "asn_name", C, max_label("Mixed")),
        "asn_series_ip": grid("ip", "asn_name", I, max_label("Mixed")),
        "asn_series_username": grid("ip_username", "asn_name", U, max_label("Mixed")),
        "asn_series_countries_list": grid("asn", "asn_name", CS, max_label("Mixed")),
        "asn_series_all": grid(
            "ip_username", "asn_name", f"{U} and {I} and {C}", max_label("Mixed"), given=[ASN]),
        "series_excluding": f"""
select country, max(attacks) as max_attacks from ({series_of_countries})
where country not in {HIDDEN!r} group by country""",
        "series_totals": f"""
select country, cast(sum(attacks) as bigint) as total from ({series_of_countries}) group by country""",
        "series_maxima": f"""
select max(attacks) as max_attacks from ({series_of_countries}) where country not in {HIDDEN!r}""",
        # volatility
        "volatile_country": volatility("country", "country", "country <> 'Unknown'"),
        "volatile_ip": volatility("ip", "ip"),
        "volatile_asn": volatility("asn_name", "asn"),
        "volatile_username": volatility("username", "username"),
        "country_volatility": q(f"""
select country, {rnd('avg(abs(pct))', 6)} as avg_volatility,
       {rnd('stddev_samp(abs(pct))', 6)} as volatility_stddev, count(*) as days_measured,
       max(abs(pct)) as max_change
from changes where country in (
  select country from daily_country group by country order by sum(attacks) desc, country limit 20)
group by country""", *change_ctes("country", "country", "true")),
        "unusual_countries": unusual("country", "country", "true", "country <> 'Unknown'"),
        "unusual_countries_username": unusual("country", "ip_username", U),
        "unusual_countries_asn": unusual("country", "asn", A),
        "unusual_country_asn_country": unusual_line("asn", f"{A} and {C}"),
        "unusual_country": unusual_line("country", C),
        "unusual_country_ip": q(f"""
select cast(date as varchar) as date, country, coalesce(attacks, 0) as attacks,
       {rnd(PCT.format(a='coalesce(attacks, 0)', p='prev'))} as pct_change
from (select *, lag(attacks) over (order by date) as prev from filled)""", HOME, f"""
filled as (select d.date, coalesce(t.country, h.country) as country, t.attacks
  from dates d cross join home h left join daily_ip t on d.date = t.date and {I})"""),
        "unusual_asns_countries": unusual("asn_name", "asn", CS),
        # summaries
        "country_summary": numbers,
        "asn_summary": grid_summary("asn_name", "asn", ", p.countries",
                                    "left join partners p on s.asn_name = p.asn_name"),
        "ip_summary": ip_numbers,
        "username_summary": username_numbers,
        # ranking and paging
        "average_rank": ranked,
        "rank_breakdown": f"""
select row_number() over (order by avg_rank, total_attacks desc, country) as final_rank, country,
       rank_total_attacks, rank_max_pct_change, rank_first_seen, avg_rank from ({ranked})
order by final_rank limit 50""",
        "entity_page": page.format(numbers=ip_numbers).replace("select *, position from", "select * from"),
        "page_count": f"""
select count(*) as rows, cast(ceil(count(*) / 25e0) as bigint) as pages from ({ip_numbers})""",
        "entity_position": f"""
select ip, total_attacks, row_number() over (order by total_attacks desc, ip) as position
from ({ip_numbers})""",
        "entity_sort": f"select * from ({numbers})",
        "entity_search": f"select * from ({numbers}) where contains(lower(country), 'nation_1')",
        # reports
        "total_count": q("select count(*) as total_attacks from raw_log"),
        "by_continent": q("""
select continent, count(*) as attacks, count(distinct ip) as unique_ips from attacks
where continent is not null group by continent"""),
        "country_stats_top": q("""
select country, count(*) as total_attacks, count(distinct ip) as unique_ips,
       count(distinct username) as unique_usernames
from attacks where country is not null group by country
order by total_attacks desc, country limit 10"""),
        "daily_last30": q("""
select cast(date as varchar) as date, total_attacks, unique_ips from daily_stats
order by date desc limit 30"""),
        "top_ips_20": q("""
select ip, min(coalesce(country, 'Unknown')) as country, min(coalesce(asn_name, 'Unknown')) as asn_name,
       count(*) as attack_count from attacks group by ip order by attack_count desc, ip limit 20"""),
        "username_stats_top": q("""
select username, count(*) as attempt_count, count(distinct ip) as unique_ips,
       count(distinct country) as unique_countries from attacks group by username
order by attempt_count desc, username limit 20"""),
        "asn_stats_top": q("""
select asn_name, count(*) as attacks, count(distinct ip) as unique_ips from attacks
where asn_name is not null group by asn_name order by attacks desc, asn_name limit 15"""),
        "hourly_share": q(f"""
select hour, attack_count, unique_ips,
       {rnd('100.0e0 * attack_count / sum(attack_count) over ()')} as percentage
from (select cast(extract(hour from datetime) as bigint) as hour, count(*) as attack_count,
             count(distinct ip) as unique_ips from raw_log group by 1)"""),
        "data_quality": q("""
select 'Total Records' as metric, count(*) as count from attacks
union all select 'Missing Country Info', count(*) from attacks
  where country is null or country in ('None', 'Unknown')
union all select 'Missing ASN Info', count(*) from attacks
  where asn is null or asn in ('None', 'Unknown')"""),
        "port_values": q("""
select port, count(*) as attacks from raw_log group by port order by attacks desc, port limit 20"""),
        "port_share": q(f"""
select port_type, attacks, {rnd('100.0e0 * attacks / sum(attacks) over ()')} as percentage
from (select case when port = 22 then 'SSH (Port 22)' else 'Other Ports' end as port_type,
             count(*) as attacks from raw_log group by 1)"""),
        "weekly_trend": q("""
select cast(cast(date_trunc('week', date) as date) as varchar) as week,
       cast(sum(total_attacks) as bigint) as attacks, avg(unique_ips) as avg_daily_ips
from daily_stats group by 1 order by 1 desc limit 12"""),
        # checks
        "enrichment_coverage": q(" union all ".join(
            f"""select year(date)::int as year, month(date)::int as month, '{c}' as "column",
  count(*) as rows, count({c}) as filled, {rnd(f'100.0e0 * count({c}) / count(*)', 1)} as filled_pct,
  cast(100.0e0 * count({c}) / count(*) > 90 as int) as enough
from attacks group by 1, 2""" for c in ("country", "asn", "asn_name"))),
        "reconcile_rollups": q(" union all ".join(
            reconcile(t) for t in ("country", "asn", "username", "ip", "ip_username"))),
        "rollup_profile": q("""
select count(*) as rows, cast(sum(attacks) as bigint) as attacks,
       count(distinct asn_name) as entities, count(distinct country) as countries from daily_asn"""),
        "asn_like_sample": q(f"""
select asn_name, country, cast(sum(attacks) as bigint) as attacks from daily_asn
where date = date '{DAY}' and asn_name like '%T_1%' group by asn_name, country"""),
        "day_top_asns": q(f"""
select asn_name, cast(sum(attacks) as bigint) as attacks from daily_asn where date = date '{DAY}'
group by asn_name order by attacks desc, asn_name limit 5"""),
        "username_day_countries": q(f"""
select username, country, cast(sum(attacks) as bigint) as attacks from daily_username
where date = date '{DAY}' and username = '{USERNAME}' group by username, country
order by attacks desc, username, country limit 5"""),
        "entity_breakdown": q(" union all ".join(
            f"""select '{d}' as dimension, cast({c} as varchar) as value,
  cast(sum(attacks) as bigint) as attacks from daily_ip_username
where username = '{USERNAME}' and {c} is not null group by {c}"""
            for d, c in (("country", "country"), ("asn", "asn_name"), ("ip", "ip"), ("date", "date")))),
        # set comparison
        "topn_diff": q(f"""
select a.country, 'only_a' as side from a where a.country not in (select country from b)
union all select b.country, 'only_b' from b where b.country not in (select country from a)""", f"""
a as (select country from daily_country where {RANGE} group by country
  order by sum(attacks) desc, country limit 10)""", f"""
b as (select country from daily_ip where {RANGE} and country is not null group by country
  order by count(distinct ip) desc, country limit 10)"""),
        "volume_vs_volatility": q(f"""
select coalesce(a.country, b.country) as country,
       case when a.country is not null and b.country is not null then 'both'
            when a.country is not null then 'only_volume' else 'only_volatility' end as membership
from a full join b on a.country = b.country""",
            *change_ctes("country", "country", RANGE), f"""
a as (select country from daily_country where {RANGE} group by country
  order by sum(attacks) desc, country limit 10)""", """
b as (select country from changes group by country order by max(abs(pct)) desc, country limit 10)"""),
        "asns_of_countries": q(f"""
select asn_name, cast(sum(attacks) as bigint) as attacks from (
  select country, asn_name, sum(attacks) as attacks,
         row_number() over (partition by country order by sum(attacks) desc, asn_name) as place
  from daily_asn where {RANGE} and country in (select country from chosen)
  group by country, asn_name) where place <= 5 group by asn_name""",
            *change_ctes("country", "country", RANGE), """
chosen as (select country from changes group by country order by max(abs(pct)) desc, country limit 10)"""),
    }
    for key in WIDE_KEYS:
        answers[f"wide_{key}"] = wide(answers[key])
    return answers | stored_answers(answers)
