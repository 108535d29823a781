"""SQL for the checking engine: what each query has to return.

Written from the meaning of the operator over the base tables, apart from the
views that give both sides the same derived input.
"""

from curbside import fixed_values as fv
from curbside.plans.derived import (
    BROKEN, CORNERS, NO_LINK, OLD_STYLE, PLACE_COLUMNS, RAW_LISTING_COLUMNS, REGION, REPEAT_PLACE, REPEATED,
)

ORACLE = {}


def _select(columns, source):
    return "select " + ", ".join(f'{e} as "{n}"' for n, e in columns.items()) + f" from {source}"


RAW = f"raw_listings as ({_select(RAW_LISTING_COLUMNS, 'part')})"
WS = r"\s\x1c-\x1f\x85\p{Z}"


def strip(e):
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


PRICE = "try_cast(nullif(regexp_replace(raw_price, '[^0-9.]', '', 'g'), '') as double)"
ADDRESS = "trim(regexp_replace(raw_address, '\\s+', ' ', 'g'))"
HOUSING = {
    "bedrooms": "try_cast(nullif(regexp_extract(raw_housing_info, '(\\d+)\\s*[bB][rR]', 1), '') as bigint)",
    "bathrooms": "try_cast(nullif(regexp_extract(raw_housing_info, '(\\d+(?:\\.\\d+)?)\\s*[bB][aA]', 1), '') as double)",
    "sqft": "try_cast(nullif(regexp_extract(raw_housing_info, '(?i)(\\d+)\\s*(?:ft|ft2|sqft)', 1), '') as bigint)",
    "property_type": "list_filter(['house', 'apartment', 'condo', 'duplex', 'townhouse', 'loft', 'land'], "
                     "lambda k: contains(lower(raw_housing_info), k))[1]",
}


def listing(source):
    return (
        f"select ordinal, coalesce(nullif(title, ''), 'No Title') as title, {PRICE} as price, {ADDRESS} as address, "
        + ", ".join(f"{e} as {n}" for n, e in HOUSING.items())
        + ", url, cast(null as varchar) as description, cast(null as varchar) as posted_date, "
        f"'redfin' as source, location from {source}"
    )


LISTINGS = f"listings as ({listing('raw_listings')})"
VALID = ("(price is null or (price > 0 and price <= 100000000)) and "
         "(bedrooms is null or bedrooms between 0 and 30) and (sqft is null or sqft >= 0)")
URL_UNIQUE = ("url_unique as (select * from raw_listings where url <> '' "
              "qualify row_number() over (partition by url order by ordinal) = 1)")
EXACT = ("distinct_exact as (select * from url_unique "
         "qualify row_number() over (partition by title, raw_price order by ordinal) = 1)")

ORACLE["price_by_location"] = f"""
with {RAW}, {URL_UNIQUE}, {EXACT}, listings as ({listing('distinct_exact')})
select location, count(*) as listings, round(avg(price), 2) as avg_price
from listings where {VALID} group by location"""

# --- expressions ------------------------------------------------------------
ORACLE["clean_price"] = f"with {RAW} select ordinal, {PRICE} as price from raw_listings"
ORACLE["clean_price_k"] = f"""
with {RAW}, texts as (
 select ordinal, lower(replace(replace(case when ordinal % 4 = 0 then replace(raw_price, ',500', 'K')
   else raw_price end, '$', ''), ',', '')) as t from raw_listings)
select ordinal, cast(coalesce(trunc(case when contains(t, 'k') then 1000 * try_cast(replace(t, 'k', '') as double)
  else try_cast(t as double) end), 0) as bigint) as price from texts"""
ORACLE["clean_address"] = f"with {RAW} select ordinal, {ADDRESS} as address from raw_listings"
ORACLE["title_address"] = f"""
with {RAW}, texts as (select ordinal, trim(concat(raw_address, ' APT ', ordinal, 'b ')) as t from raw_listings)
select ordinal, array_to_string(list_transform(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]+'),
  lambda w: upper(w[1]) || lower(w[2:])), '') as address from texts"""
ORACLE["housing_info"] = (
    f"with {RAW} select ordinal, " + ", ".join(f"{e} as {n}" for n, e in HOUSING.items()) + " from raw_listings"
)
ORACLE["housing_info_split"] = f"""
with {RAW}, texts as (select ordinal, string_split(lower(replace(raw_housing_info, ' / 1.5ba', '')), '-') as parts
  from raw_listings)
select ordinal,
 list_filter(list_transform(list_filter(parts, lambda p: contains(p, 'br')),
   lambda p: try_cast(trim(replace(p, 'br', '')) as bigint)), lambda n: n is not null)[-1] as bedrooms,
 list_filter(list_transform(list_filter(parts, lambda p: not contains(p, 'br')
     and (contains(p, 'ft2') or contains(p, 'ft²') or contains(p, 'sqft'))),
   lambda p: try_cast(trim(replace(replace(replace(p, 'ft2', ''), 'ft²', ''), 'sqft', '')) as bigint)),
   lambda n: n is not null)[-1] as sqft
from texts"""
ORACLE["property_type"] = (
    f"with {RAW} select ordinal, {HOUSING['property_type']} as property_type from raw_listings"
)
ORACLE["strip_boilerplate"] = f"with {RAW} select ordinal, trim(title) as description from raw_listings"
ORACLE["absolute_url"] = """
select p_partkey, case p_partkey % 8
 when 0 then concat('https://columbus.craigslist.org/d/', p_partkey)
 when 1 then concat('https://columbus.craigslist.org/d/', p_partkey, '?x=1')
 when 2 then concat('https://h.example/', p_partkey)
 when 3 then concat('https://columbus.craigslist.org?q=', p_partkey)
 when 4 then concat('https://x.example/', p_partkey)
 when 5 then concat('https://columbus.craigslist.org/b/', p_partkey)
 when 6 then concat('https://columbus.craigslist.org#', p_partkey)
 else concat('mailto:', p_partkey) end as url from part"""
ORACLE["absolute_post_url"] = """
select page_id, case when page_id % 2 = 0 then concat('https://www.facebook.com/posts/', page_id) else url end as url
from pages"""
ORACLE["strip_json_prefix"] = """
select c_custkey, case c_custkey % 3 when 0 then concat('{"k":"a&&', c_custkey, '"}')
 when 1 then concat('{"k":', c_custkey, '}') else concat('x', chr(10), 'y&&', c_custkey) end as body from customer"""
ORACLE["post_text_fallback"] = f"""
select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda l: {strip('l')}), lambda l: length(l) > 10)[1:5], chr(10)) as text from documents"""
ORACLE["reaction_count"] = """
select doc_id, case doc_id % 4 when 0 then n_chars when 1 then 0 when 2 then null else n_chars end as likes
from documents"""
ORACLE["comment_count"] = """
select doc_id, case doc_id % 3 when 0 then
   case when n_chars >= 1000000 then n_chars // 1000000 when n_chars >= 1000 then n_chars // 1000 else n_chars end
 when 1 then 0 else n_chars end as comments_count from documents"""
ORACLE["post_id"] = """
select doc_id, case when doc_id % 3 = 0 then concat('/posts/', doc_id)
 when doc_id % 5 <> 0 and source <> '' and text <> '' then source || '_' || sha256(substring(text, 1, 100))
 else 'post_' || sha256((case when doc_id % 5 <> 0 then source else '' end) || chr(31) || text) end as id
from documents"""

# --- cleaning and filters ---------------------------------------------------
ORACLE["to_listing"] = f"with {RAW}, {LISTINGS} select * from listings"
ORACLE["validate"] = (
    f"with {RAW}, {LISTINGS} select ordinal, price, bedrooms, sqft from listings where {VALID}"
)
ORACLE["validate_strict"] = (
    f"with {RAW}, {LISTINGS} select ordinal, price, sqft from listings "
    "where price between 100 and 100000000 and (sqft is null or sqft between 50 and 50000)"
)
ORACLE["model_check"] = f"""
with {RAW} select ordinal, url, title, location, 'redfin' as source from raw_listings
where ordinal % 31 <> 0 and ordinal % 29 <> 0"""
ORACLE["listing_rejects"] = f"""
with {RAW}, {LISTINGS} select 'clean' as stage,
 case when not (price is null or (price > 0 and price <= 100000000)) then 'price'
      when not (bedrooms is null or bedrooms between 0 and 30) then 'bedrooms' else 'sqft' end as reason,
 count(*) as rows from listings where not ({VALID}) group by all"""
ORACLE["filter_price"] = (
    f"with {RAW}, {LISTINGS} select ordinal, location, price from listings where price between 950000 and 1200000"
)
PLACES = ("places as (select c_custkey, ((c_custkey * 7919) % 700 - 88300) / 1000e0 as lon, "
          "((c_custkey * 104729) % 500 + 42750) / 1000e0 as lat from customer)")
ORACLE["filter_region"] = f"""
with {PLACES} select * from places
where lon between -88.07e0 and -87.82e0 and lat between 42.84e0 and 43.19e0"""
ORACLE["filter_region_polygon"] = f"""
with {PLACES} select * from places where lat >= 42.8e0 and lat < 43.2e0
 and lon < -87.7e0 + (lat - 42.8e0) * ((-87.95e0 - -87.7e0) / (43.2e0 - 42.8e0))
 and lon >= -87.95e0 + (lat - 43.2e0) * ((-88.2e0 - -87.95e0) / (42.8e0 - 43.2e0))"""
ORACLE["filter_type_codes"] = (
    "select p_partkey, p_size % 9 as type_code from part where p_size % 9 in (1, 2, 3, 4, 5, 6)"
)

# --- duplicates -------------------------------------------------------------
ORACLE["dedup_url"] = f"with {RAW}, {URL_UNIQUE} select ordinal, url from url_unique"
ORACLE["dedup_in_location"] = f"""
with {RAW} select ordinal, location, url from raw_listings
qualify row_number() over (partition by location, url order by ordinal) = 1"""
ORACLE["first_seen"] = f"""
with {RAW} select ordinal, url, row_number() over (partition by url order by ordinal) > 1 as is_duplicate
from raw_listings"""
ORACLE["not_yet_published"] = f"""
with {RAW} select ordinal, url from raw_listings where url not in
 (select concat('https://listings.example/d/', p_partkey) from part where p_size > 10)"""
ORACLE["dedup_similar_exact"] = (
    f"with {RAW}, {URL_UNIQUE}, {EXACT} select ordinal, title, raw_price from distinct_exact"
)
# Ratio above 90 means 20 * LCS > 9 * T. The row of the LCS table for each
# character of one title is a running maximum over the row before it. The
# greedy choice walks the rows that have an earlier similar row, in order.
SIMILAR = f"""
{URL_UNIQUE}, {EXACT},
candidates as (
 select x.ordinal as a, y.ordinal as b, x.title as ta, y.title as tb
 from distinct_exact x join distinct_exact y
   on x.raw_price is not distinct from y.raw_price and x.ordinal < y.ordinal
 where 10 * abs(length(x.title) - length(y.title)) < length(x.title) + length(y.title)
   and 10 * levenshtein(x.title, y.title) < length(x.title) + length(y.title)),
measured as (
 select a, b, length(ta) + length(tb) as t,
  list_reduce(
   list_transform(string_split(ta, ''), lambda c: list_transform(string_split(tb, ''), lambda d: (c = d)::int)),
   lambda before, hit: list_transform(range(1, len(hit) + 1), lambda j: list_max(list_transform(
     range(1, j + 1), lambda i: greatest(before[i], hit[i] * (1 + coalesce(before[i - 1], 0))))))::int[],
   list_transform(string_split(tb, ''), lambda d: 0::int))[-1] as lcs
 from candidates),
edges as materialized (select a, b from measured where 20 * lcs > 9 * t),
rivals as materialized (select b, list(a) as before, row_number() over (order by b) as k from edges group by b),
walk(k, gone) as (
 select 0::bigint, []::bigint[]
 union all
 select r.k, case when len(list_filter(r.before, lambda a: not list_contains(w.gone, a))) > 0
   then list_append(w.gone, r.b) else w.gone end
 from walk w join rivals r on r.k = w.k + 1),
gone as (select unnest(gone) as ordinal from (select gone from walk order by k desc limit 1))"""
ORACLE["dedup_similar_fuzzy"] = (
    f"with recursive {RAW}, {SIMILAR} select ordinal, title, raw_price from distinct_exact "
    "where ordinal not in (select ordinal from gone)"
)
ORACLE["similar_pairs"] = (
    f"with recursive {RAW}, {SIMILAR} select b, min(a) as a from edges where b in (select ordinal from gone) "
    "and a not in (select ordinal from gone) group by b"
)
SEEN = ("seen as (select conv_id as feed, cast(turn + 1 + again as int) as snapshot_no, 1 - again as position, "
        "role as author, text from conversations, (values (0), (1)) v(again))")
ORACLE["dedup_posts"] = f"""
with {SEEN}, ids as (select *, case when author <> '' and text <> ''
   then author || '_' || sha256(substring(text, 1, 100)) else 'post_' || sha256(author || chr(31) || text) end as id
  from seen)
select feed, snapshot_no, position, id from ids
qualify row_number() over (partition by feed, id order by snapshot_no, position) = 1"""

# --- pages ------------------------------------------------------------------


def unescape(e):
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "),
                         ("&copy;", "©"), ("&middot;", "·")):
        e = f"replace({e}, '{entity}', '{char}')"
    # A text cut short may end in an entity without its semicolon.
    return f"regexp_replace({e}, '&amp;?', '&', 'g')"


NAV_LINK = '<li><a href="([^"]*)">([^<]*)</a></li>'
ORACLE["extract_nav_links"] = f"""
with items as (select page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) as li,
  generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>'), 1) - 1 as position from pages)
select page_id, position, {unescape(f"regexp_extract(li, '{NAV_LINK}', 1)")} as url,
 {unescape(f"regexp_extract(li, '{NAV_LINK}', 2)")} as title from items"""
ORACLE["extract_headings"] = f"""
select page_id, case when html like '%<h1>%' then {strip(unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} end as title,
 case when html like '%<div class="ad">%' then {strip(unescape("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)"))} end as ad,
 list_transform(regexp_extract_all(html, '<p>((?:</?b>|<br>|[^<])*)', 1), lambda p:
  {strip(unescape("regexp_replace(p, '<[^>]*>', '', 'g')"))}) as paragraphs,
 {strip(unescape("regexp_replace(regexp_extract(html, '(?s)</nav>(.*)', 1), '<!--.*?-->|<[^>]*>', '', 'g')"))} as description
from pages"""


def _placed(columns, condition):
    place = ", ".join(f'{e} as "{n}"' for n, e in columns.items())
    return f"select *, {place}, {NO_LINK} as no_link, {OLD_STYLE} as old_style from part where {condition}"


PLACED = f"placed as ({_placed(PLACE_COLUMNS, 'true')} union all {_placed(REPEAT_PLACE, REPEATED)})"
HREF = "case when p_partkey % 3 = 0 then concat('/d/', p_partkey) else concat('https://x.example/d/', p_partkey) end"
ROW_PRICE = "case when p_partkey % 10 = 3 then null else concat('$', p_size, ',000') end"
# The position among the rows of the page counts the rows without a link too.
ORACLE["extract_search_rows"] = f"""
with {PLACED} select location_key, keyword_idx, "offset",
 (row_number() over (partition by location_key, keyword_idx, "offset" order by position) - 1)::int as position,
 {HREF} as url, concat(p_name, ' & ', p_brand) as title, {ROW_PRICE} as raw_price
from placed qualify not no_link"""
ORACLE["extract_search_rows_simple"] = f"""
with {PLACED} select location_key, keyword_idx, "offset",
 (row_number() over (partition by location_key, keyword_idx, "offset" order by position) - 1)::int as position,
 case when no_link then null else {HREF} end as url, concat(p_name, ' & ', p_brand) as title, {ROW_PRICE} as price
from placed where old_style"""
BODY = "concat(p_name, ' <b>', {nl}, 'line two', p_brand)"
ORACLE["extract_details"] = f"""
select p_partkey as page_id, p_name as title, concat('$', p_size, ',500') as raw_price,
 case when p_partkey % 4 = 1 then null else concat(p_partkey, ' Main St') end as raw_address,
 concat(' ', p_size % 7, 'BR / 1.5Ba ', 600 + p_size, 'ft2 fee: $', p_size, lower(p_type), 'fee: ', p_brand, ': x') as raw_housing_info,
 {BODY.format(nl="' '")} as description, concat('2024-01-', lpad(cast(p_size % 28 + 1 as varchar), 2, '0')) as posted_date
from part where p_partkey % 9 <> 0"""
ORACLE["extract_attributes"] = f"""
select p_partkey as page_id, {BODY.format(nl="chr(10)")} as description, 'fee' as name, concat(p_brand, ': x') as value
from part where p_partkey % 9 <> 0"""
ORACLE["extract_profiles"] = f"""
with details as ({ORACLE["extract_details"]}), named as ({ORACLE["extract_attributes"]})
select d.page_id, d.title, d.raw_housing_info, d.posted_date, n.name, n.value from details d join named n using (page_id)"""
CITY = "case location_key when 'milwaukee' then 'milwaukee_wi' else 'columbus_oh' end"
ORACLE["page_yield"] = f"""
with {PLACED}, linked as (select *, row_number() over (partition by location_key, p_partkey
  order by keyword_idx, "offset", position) as sighting from placed where not no_link)
select location_key as location, keyword_idx, "offset", count(*) as results, count(*) filter (sighting = 1) as new_results
from linked group by all"""
COUNTED = (f"{PLACED}, counted as (select location_key as location, keyword_idx, \"offset\", "
           "count(*) filter (not no_link) as results from placed group by all)")
REACHED = ("reached as (select * from counted qualify keyword_idx = 0 or (coalesce(sum((results < 120)::int) over ("
           "partition by location, keyword_idx order by \"offset\" rows between unbounded preceding and 1 preceding), 0) = 0 "
           "and row_number() over (partition by location, keyword_idx order by \"offset\") - 1 = \"offset\" / 120))")
ORACLE["truncate_short_pages"] = f"with {COUNTED}, {REACHED} select * from reached"
ORACLE["cap_per_location"] = f"""
with {RAW} select ordinal, location from raw_listings
qualify row_number() over (partition by location order by ordinal) <= 100"""
ORACLE["join_details"] = f"""
with {RAW} select r.ordinal, r.url, r.title, r.raw_price, r.location, p.p_brand as raw_address, p.p_type as description
from raw_listings r left join part p
 on p.p_partkey % 9 <> 0 and r.url = concat('https://listings.example/d/', p.p_partkey)"""
ORACLE["join_location"] = """
select p_partkey, case p_partkey % 3 when 0 then 'https://milwaukee.craigslist.org'
 else 'https://columbus.craigslist.org' end as base_url,
 case p_partkey % 3 when 0 then 'milwaukee_wi' else 'columbus_oh' end as location
from part where p_partkey % 3 < 2"""
ORACLE["union_locations"] = f"""
with {RAW} select ordinal + case location when 'milwaukee_wi' then 0 else 72057594037927936 end as ordinal, location, url
from raw_listings"""
ORACLE["union_keywords"] = (
    f"with {RAW} select ordinal, location, url, cast(ordinal % 5 as int) as keyword_idx from raw_listings"
)
ORACLE["count_by_location"] = (
    f"with {RAW} select location, count(*) as listings from raw_listings group by rollup (location)"
)
ORACLE["funnel"] = f"""
with {RAW}, {URL_UNIQUE}, {EXACT}, listings as ({listing('distinct_exact')})
select 'raw' as stage, count(*) as rows from raw_listings union all
select 'url_unique', count(*) from url_unique union all
select 'similar_unique', count(*) from distinct_exact union all
select 'valid', count(*) from listings where {VALID} union all
select 'rejected', count(*) from listings where not ({VALID})"""

# --- payloads ---------------------------------------------------------------
HOMES = """
homes as (
 select o.*, c.*, o_orderkey as k,
  case when o_orderkey % 2 = 0 then 'milwaukee' else 'columbus' end as location_key,
  cast(o_orderkey // 40 as bigint) as batch,
  row_number() over (partition by o_orderkey % 2, o_orderkey // 40 order by o_orderkey) - 1 as pos
 from orders o join customer c on o_custkey = c_custkey)"""
USABLE = f"""
{HOMES},
facts as (
 select *, case when k % 13 in (2, 3, 4, 5) then null when floor(o_totalprice) = 0 then null
     else cast(floor(o_totalprice) as bigint) end as price,
  case when k % 11 in (4, 5, 6) then null else 500 + k % 3000 end as size,
  case when k % 17 = 5 then case when k % 2 = 0 then 'Milwaukee' else 'Columbus' end
    when k % 17 = 6 then 'None' else c_mktsegment end as city,
  case when k % 18 >= 9 then cast(k % 9 as varchar) else case k % 9 when 1 then 'house' when 2 then 'condo' when 3 then 'townhouse' when 4 then 'multi-family'
    when 5 then 'land' when 6 then 'other' when 7 then '7' when 8 then '8' end end as kind,
  case k % 7 when 0 then null when 1 then 'None' when 2 then '3.0' else cast(k % 7 as varchar) end as beds
 from homes where k % 13 <> 1),
lined as (
 select *,
  concat(k, ' Main St, ', city, ', ', case when k % 2 = 0 then 'WI' else 'OH' end, ' ', 43000 + c_nationkey) as raw_address,
  concat(coalesce(beds, '?'), 'BR/1.5BA ', coalesce(kind, 'Property'), ' in ', city) as title,
  case when price is null then null else '$' || format('{{:,}}', price) end as raw_price,
  concat(coalesce(beds, ''), 'br - ', coalesce(cast(size as varchar), ''), 'ft2 - ', coalesce(kind, '')) as raw_housing_info,
  concat(coalesce(beds, '?'), ' bed, 1.5 bath ', coalesce(kind, 'property'), ' at ', k, ' Main St, ', city, ', ',
   case when k % 2 = 0 then 'WI' else 'OH' end, '. ',
   case when size is null then '' else format('{{:,}} sqft. ', size) end,
   case when k % 5 = 0 then concat('Built ', 1900 + k % 120, '. ') else '' end,
   case when k % 4 = 0 then format('Lot: {{:,}} sqft. ', 1000 + k) else '' end,
   case when k % 6 = 0 and k % 400 > 0 then concat('HOA: $', k % 400, '/mo. ') else '' end,
   case when k % 3 = 0 and k % 90 > 0 then concat(k % 90, ' days on market. ') else '' end,
   'MLS# M', o_custkey, '. Status: ', o_orderstatus, '.') as description,
  case when k % 19 = 7 then '' else concat('https://www.redfin.com/home/', k) end as url,
  case when k % 2 = 0 then 'milwaukee_wi' else 'columbus_oh' end as location
 from facts)"""
ORACLE["payload_normalize"] = f"""
with {USABLE} select title, raw_price, raw_address, raw_housing_info, description, url, location, 'redfin' as source,
 kind as property_type, concat('M', o_custkey) as mls_id,
 case when k % 10 = 0 then null else cast(k % 5 as varchar) end as listing_id,
 case when k % 5 = 0 then 1900 + k % 120 end as year_built,
 cast(case when k % 4 = 0 then 1000 + k end as double) as lot_size,
 cast(case when k % 6 = 0 then k % 400 end as double) as hoa,
 case when k % 3 = 0 then k % 90 end as days_on_market, o_orderstatus as mls_status
from lined"""
ORACLE["payload_cap"] = f"""
with {HOMES} select location_key, batch, cast(pos as int) as pos, concat(k, ' Main St') as street
from homes where pos < 7"""
ORACLE["payload_rejects"] = f"""
with {HOMES} select 'payload' as stage, concat(k, ' Main St') as street, 'null or misshapen part' as reason
from homes where k % 13 = 1"""
ORACLE["listings_from_payloads"] = f"""
with recursive {USABLE},
raw_listings as (select row_number() over (order by (location_key = 'columbus')::int, batch, pos) as ordinal, * from lined),
{SIMILAR},
listings as (select title, {PRICE} as price, raw_address as address, {", ".join(f"{e} as {n}" for n, e in HOUSING.items())},
  url, description, cast(null as varchar) as posted_date, 'redfin' as source, location
  from distinct_exact where ordinal not in (select ordinal from gone))
select * from listings where {VALID}"""

# --- posts ------------------------------------------------------------------
POSTS = f"""
{SEEN},
cards as (
 select feed, snapshot_no, (row_number() over (partition by feed, snapshot_no order by position) - 1)::int as position,
  author, {strip('text')} as text, length(text) as n, case when length(text) % 3 = 0 then ''
    else concat('https://www.facebook.com/posts/', md5(text)) end as url,
  case when length(text) % 3 = 0 then '' else '2h' end as timestamp,
  case when length(text) % 5 = 0 then null else length(text) end as likes,
  cast(length(text) % 50 as bigint) as comments_count from seen),
posts as (
 select *, case when url <> '' then url when author <> '' and text <> ''
   then author || '_' || sha256(substring(text, 1, 100)) else 'post_' || sha256(author || chr(31) || text) end as id
 from cards)"""
ORACLE["extract_posts"] = f"""
with {POSTS} select feed, snapshot_no, position, author, text, timestamp, url, likes, comments_count,
 0::bigint as shares, '2024-06-01T00:00:00' as scraped_at, id from posts where likes is not null"""
ORACLE["post_rejects"] = f"""
with {POSTS} select 'posts' as stage, id as key, 'unreadable reaction label' as reason, count(*) as rows
from posts where likes is null group by id"""
ORACLE["posts_from_snapshots"] = f"""
with {POSTS}, kept as (select * from posts where likes is not null),
firsts as (select feed, id, min(snapshot_no) as no from kept group by all),
productive as (select distinct feed, no from firsts union select distinct feed, 0 from kept),
gaps as (select feed, no, lead(no) over (partition by feed order by no) as next from productive),
ends as (select feed, min(no) + 5 as last from gaps where next is null or next > no + 5 group by feed),
fresh as (select k.* from kept k join ends e on k.feed = e.feed and k.snapshot_no <= e.last
  qualify row_number() over (partition by k.feed, id order by snapshot_no, position) = 1)
select feed, snapshot_no, position, author, text, likes, comments_count from fresh"""
ORACLE["cap_posts"] = f"""
with {SEEN} select feed, snapshot_no, position, md5(text) as id from seen order by feed, snapshot_no, position limit 20"""
ORACLE["snapshot_yield"] = f"""
with {SEEN}, firsts as (select feed, md5(text) as id, min(snapshot_no) as snapshot_no from seen group by all),
fresh as (select feed, snapshot_no, count(*) as n from firsts group by all)
select s.feed, s.snapshot_no, coalesce(n, 0) as new_posts,
 cast(sum(coalesce(n, 0)) over (partition by s.feed order by s.snapshot_no) as bigint) as total_posts
from (select distinct feed, snapshot_no from seen) s left join fresh f
 on f.feed = s.feed and f.snapshot_no = s.snapshot_no"""
ORACLE["truncate_stale"] = """
with seen as (
 select conv_id as feed, cast(turn + 1 + case when turn > 1 and conv_id % 2 = 0 then 5 when turn > 3 then 4 else 0 end
   as int) as snapshot_no, md5(text) as id from conversations),
firsts as (select feed, id, min(snapshot_no) as no from seen group by all),
productive as (select distinct feed, no from firsts union select distinct feed, 0 from seen),
gaps as (select feed, no, lead(no) over (partition by feed order by no) as next from productive),
ends as (select feed, min(no) + 5 as last from gaps where next is null or next > no + 5 group by feed)
select s.* from seen s join ends e on s.feed = e.feed where s.snapshot_no <= e.last"""
ORACLE["post_totals"] = f"with {SEEN} select count(distinct (feed, md5(text))) as total_posts from seen"

# --- attempts ---------------------------------------------------------------
LEDGER = """
attempts as (
 select user_id as session, ts, event_id, event_type <> 'error' as success,
  coalesce(sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id
    rows between unbounded preceding and 1 preceding), 0)::bigint as before from events),
ledger as (
 select session, ts, event_id, success, before + 1 as action_number, 10 - before - success::int as remaining
 from attempts where before < 10)"""
ORACLE["quota_ledger"] = f"with {LEDGER} select * from ledger"


def _inside() -> str:
    """By the three kinds of region: between the sides of the box, or an odd
    number of edges to the east."""
    kinds = []
    for n, corners in enumerate(CORNERS):
        ends = [(f"((g.x + {a} * g.r) / 1000e0)", f"((g.y + {b} * g.r) / 1000e0)") for a, b in corners]
        bounds = (f"p.lon between (g.x - g.r) / 1000e0 and (g.x + g.r) / 1000e0 and p.lat between (g.y - g.r) / 1000e0 and (g.y + g.r) / 1000e0")
        crossed = " + ".join(
            f"case when ({y1} > p.lat) <> ({y2} > p.lat) and p.lon < {x1} + (p.lat - {y1}) * (({x2} - {x1}) / nullif({y2} - {y1}, 0)) then 1 else 0 end"
            for (x1, y1), (x2, y2) in zip(ends, ends[1:])
        )
        kinds.append(f"when {n} then {bounds}" + (f" and ({crossed}) % 2 = 1" if n else ""))
    return f"case s_suppkey % {len(CORNERS)} {' '.join(kinds)} end"


ORACLE["join_regions"] = f"""
with p as (select c_custkey, ((c_custkey * 7919) % 700 - 88300) / 1000e0 as lon, ((c_custkey * 104729) % 500 + 42750) / 1000e0 as lat from customer),
g as (select s_suppkey, {", ".join(f"{e} as {n}" for n, e in REGION.items())} from supplier)
select c_custkey, s_suppkey from p, g where {_inside()}"""

ORACLE["stream_quota"] = ORACLE["quota_ledger"]
ORACLE["ledger_totals"] = (
    f"with {LEDGER} select count(*) as attempts, count(*) filter (success) as total_actions from ledger"
)
ORACLE["sample_exact"] = (
    "select event_id, user_id from events order by md5(concat(event_id, '-s1')), event_id limit 50"
)

# --- whole jobs and streams -------------------------------------------------
# Raw listings under the names that the shared parts above expect.
# What the detail page of a row adds; one row in nine has none.
DETAIL_COLUMNS = f"""
  case when p_partkey % 9 = 0 or p_partkey % 4 = 1 then null else concat(p_partkey, ' Main St') end as raw_address,
  case when p_partkey % 9 > 0 then concat(p_size % 7, 'BR / 1.5Ba ', 600 + p_size, 'ft2 fee: $', p_size, lower(p_type),
   'fee: ', p_brand, ': x') end as raw_housing_info,
  case when p_partkey % 9 > 0 then {BODY.format(nl="' '")} end as description,
  case when p_partkey % 9 > 0 then concat('2024-01-', lpad(cast(p_size % 28 + 1 as varchar), 2, '0')) end as posted_date"""
FROM_PAGES = f"""
{COUNTED}, {REACHED},
firsts as (
 select p.*, (p.location_key = 'columbus')::int as place from placed p
  join reached r on r.location = p.location_key and r.keyword_idx = p.keyword_idx and r."offset" = p."offset"
 where not no_link
 qualify row_number() over (partition by p.location_key, p_partkey order by p.keyword_idx, p."offset", p.position) = 1),
raw_listings as (
 select row_number() over (order by place, keyword_idx, "offset", position) as ordinal, p_partkey,
  case when p_partkey % 3 > 0 then concat('https://x.example/d/', p_partkey)
   else concat('https://', location_key, '.craigslist.org/d/', p_partkey) end as url,
  concat(p_name, ' & ', p_brand) as title, {ROW_PRICE} as raw_price, {CITY} as location,
  {DETAIL_COLUMNS}
 from firsts)"""
ORACLE["listings_from_pages"] = f"""
with recursive {FROM_PAGES}, {SIMILAR},
listings as (
 select title, {PRICE} as price, {ADDRESS} as address, {", ".join(f"{e} as {n}" for n, e in HOUSING.items())},
  url, description, posted_date, 'redfin' as source, location
 from distinct_exact where ordinal not in (select ordinal from gone))
select * from listings where {VALID}"""
ORACLE["page_rejects"] = f"""
with {FROM_PAGES} select 'html' as stage, cast(p_partkey as varchar) as key from raw_listings where {BROKEN}"""
ORACLE["stream_listings"] = f"""
with {PLACED}, raw_listings as (
 select distinct {CITY} as location, case when p_partkey % 3 > 0 then concat('https://x.example/d/', p_partkey)
   else concat('https://', location_key, '.craigslist.org/d/', p_partkey) end as url,
  concat(p_name, ' & ', p_brand) as title, {ROW_PRICE} as raw_price from placed where not no_link),
priced as (select location, url, title, {PRICE} as price, 'redfin' as source from raw_listings)
select * from priced where price is null or (price > 0 and price <= 100000000)"""
ORACLE["stream_listings_published"] = ORACLE["stream_listings"]
ORACLE["stream_listings_details"] = f"""
with {PLACED}, raw_listings as (
 select distinct {CITY} as location, case when p_partkey % 3 > 0 then concat('https://x.example/d/', p_partkey)
   else concat('https://', location_key, '.craigslist.org/d/', p_partkey) end as url,
  concat(p_name, ' & ', p_brand) as title, {ROW_PRICE} as raw_price, {DETAIL_COLUMNS} from placed where not no_link),
listings as (
 select title, {PRICE} as price, {ADDRESS} as address, {", ".join(f"{e} as {n}" for n, e in HOUSING.items())},
  url, description, posted_date, 'redfin' as source, location from raw_listings)
select * from listings where {VALID}"""
ORACLE["stream_funnel"] = f"""
with {PLACED}, rows as (select {CITY} as location, p_partkey, {ROW_PRICE} as raw_price from placed where not no_link),
firsts as (select distinct location, p_partkey, raw_price from rows), priced as (select *, {PRICE} as price from firsts)
select 'raw' as stage, count(*) as rows from rows union all select 'url_unique', count(*) from firsts
union all select 'valid', count(*) from priced where price is null or (price > 0 and price <= 100000000)"""
ORACLE["stream_page_yield"] = f"""
with {PLACED}, linked as (select *, row_number() over (partition by location_key, p_partkey
  order by keyword_idx, "offset", position) as sighting from placed where not no_link)
select location_key as location, keyword_idx, "offset",
 date_trunc('hour', timestamp '2024-01-01' + to_hours(keyword_idx) + to_seconds("offset")) as window_start,
 count(*) as results, count(*) filter (sighting = 1) as new_results
from linked group by all"""
ORACLE["stream_snapshot_yield"] = f"""
with {SEEN}, timed as (select feed, snapshot_no, md5(text) as id, row_number() over (partition by feed, md5(text) order by snapshot_no) as nth from seen)
select feed, timestamp '2024-01-01' + to_hours(3 * (snapshot_no // 3)) as window_start, count(*) as sightings,
 count(*) filter (nth = 1) as new_posts
from timed group by all"""
ORACLE["stream_truncate_pages"] = ORACLE["truncate_short_pages"]
ORACLE["stream_truncate_stale"] = ORACLE["truncate_stale"]
ORACLE["stream_posts"] = """
select distinct role || '_' || sha256(substring(text, 1, 100)) as id, role as author, text from conversations"""

# --- what was written and read back -----------------------------------------
ORACLE["csv_round_trip"] = f"""
with {RAW}, {LISTINGS} select title, cast(price as varchar) as price, address, cast(bedrooms as varchar) as bedrooms,
 cast(bathrooms as varchar) as bathrooms, cast(sqft as varchar) as sqft, url, source, location, property_type
from listings where {VALID} and url <> ''"""
ORACLE["json_round_trip"] = f"with {RAW}, {LISTINGS} select * exclude (ordinal) from listings where {VALID}"
ORACLE["export_round_trip"] = f"""
with {RAW}, {LISTINGS}, valid as (select * from listings where {VALID}),
counts as (select location, count(*) as rows, sum(price) as total from valid group by location)
select location, rows, total, form from counts, (values ('parquet'), ('csv'), ('json')) v(form)"""
ORACLE["posts_round_trip"] = f"""
with {POSTS} select id, author, text, timestamp, likes, comments_count, 0::bigint as shares, url,
 '2024-06-01T00:00:00' as scraped_at, (feed * 4096 + snapshot_no) * 4096 + position as ordinal from posts where likes is not null"""
ORACLE["posts_document_round_trip"] = f"""
with {POSTS} select id, author, text, timestamp, likes, comments_count, 0::bigint as shares, url,
 '2024-06-01T00:00:00' as scraped_at, row_number() over (order by feed, snapshot_no, position) - 1 as ordinal
from posts where likes is not null"""
ORACLE["posts_metadata"] = f"""
with {POSTS} select '2024-06-01T00:00:00' as scraped_at, count(*) as total_posts, 'facebook_feed' as source
from posts where likes is not null"""
ORACLE["ledger_round_trip"] = f"""
with {LEDGER} select 'comment' as action, cast(event_id as varchar) as text, action_number, success,
 cast(null as varchar) as error from ledger"""
ORACLE["payloads_round_trip"] = f"""
with {HOMES} select location_key, batch as payload_no, count(*) as homes from homes group by all"""
ORACLE["ledger_metadata"] = f"""
with {LEDGER} select '2024-01-01T00:00:00' as session_start, count(*) filter (success) as total_actions,
 10::bigint as daily_limit from ledger"""
ORACLE["pages_round_trip"] = f"""
with {PLACED} select location_key as location, kind, source, count(*) as pages from (
 select distinct location_key, keyword_idx, "offset", case when keyword_idx = 0 then 'landing' else 'search' end as kind,
  'redfin' as source from placed union all
 select case when p_partkey % 2 = 0 then 'milwaukee' else 'columbus' end, 0, p_partkey, 'detail', 'redfin'
 from part where p_partkey % 9 <> 0 or {BROKEN}) group by all"""
