"""Deterministic input tables, derived from the driver's by SQL that both engines accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MD = "md5(cast(event_id as {STR}))"
_SH = "{SHA}(cast(event_id as {STR}){BITS})"
_B58 = f"translate(concat({_SH},{_MD}),'0','z')"

_PLANTED = f"""
select event_id, case event_id % 16
  when 0 then concat('Key: ',{_SH}) when 1 then concat('0x',{_SH})
  when 2 then concat('K',substr({_B58},1,50)) when 3 then concat('xprv',substr(concat({_B58},{_B58}),1,107))
  when 4 then substr({_B58},1,64) when 5 then concat('id AKIA',upper(substr({_MD},1,16)))
  when 6 then concat('GH_TOKEN=ghp_',{_MD},substr({_SH},1,4)) when 7 then concat('sk_live_',substr({_MD},1,24))
  when 8 then concat('sk-ant-',{_SH},{_MD}) when 9 then concat('xoxb-',substr({_MD},1,10),'-',substr({_SH},1,24))
  when 10 then concat('AC',{_MD}) when 11 then concat('Bearer eyJ',substr({_MD},1,17),'.',substr({_MD},1,20),'.',substr({_SH},1,30))
  when 12 then concat('export db_url = ',substr({_MD},1,15))
  when 13 then concat('1. abandon 2. ability able about above absent ', case when event_id % 32 < 16 then 'absorb abstract' when event_id % 64 < 32 then 'zoo zebra' else 'xyz abstract' end)
  when 14 then concat('order ',substr({_MD},1,29)) else concat('tok ',{_MD}) end as text
from {{events}}"""

SQL = {
    "planted_text": _PLANTED,
    "ocr_words": """
select cast(floor(event_id/12.0) as bigint) as frame_idx, cast(floor((event_id%12)/3.0) as int) as line_no, cast(event_id%3 as int) as word_no,
  cast(cast((event_id*7)%400 as double) - 19.5 as float) as x, cast(cast((event_id*5)%50 as double) - 3.75 as float) as y,
  cast(cast(30+event_id%20 as double) + 0.25 as float) as w, cast(10+event_id%9 as float) as h
from {events}""",
    "ocr_lines": f"""
select cast(floor(event_id/12.0) as bigint) as frame_idx, event_id%12 as line_no, text, 20+400*((event_id*7)%2) as x,
  40+24*cast(floor((event_id%12)/2.0) as bigint)+(event_id*5)%17 as y, cast(300 as bigint) as w, 12+(event_id*3)%9 as h
from ({_PLANTED}) p""",
    "hex_rows": f"""
select cast(floor(event_id/8.0) as bigint) as frame_idx, event_id%8 as row_id,
  case when event_id%8=3 then 40+20*(event_id%8)+(event_id%3)*30 else 40+20*(event_id%8) end as y, cast(20 as bigint) as x, cast(300 as bigint) as w, 14+(event_id%3) as h,
  case when event_id%8 in (1,2) then case when event_id%16<8 then concat('0x',substr({_SH},1,32)) else substr({_SH},1,32) end
    when event_id%8=4 then substr({_MD},1,20) when event_id%8=5 then concat(substr({_MD},1,10),' ',substr({_MD},11,10))
    when event_id%8=6 then 'Send to wallet' else substr({_MD},1,6) end as text
from {{events}}""",
    "qr_payloads": f"""
select event_id as qr_id, case event_id % 12 when 0 then concat('0x',{_MD},substr({_SH},1,8)) when 1 then concat('0x',{_SH})
  when 2 then concat('EQ',{_MD},substr({_SH},1,14)) when 3 then concat('T',translate(concat({_MD},'a'),'0','z'))
  when 4 then concat('bc1q',{_MD},substr({_SH},1,6)) when 5 then translate({_MD},'0','z')
  when 6 then concat('ethereum:0x',{_MD}) when 7 then concat('Bitcoin:',{_MD})
  when 8 then 'abandon ability able about above absent absorb abstract absurd abuse access accident'
  when 9 then 'abandon ability able about above absent absorb abstract absurd abuse access accident acid'
  when 10 then concat('  ton://transfer/',{_MD},' ') else concat('https://example.com/',{_MD}) end as payload,
  cast(event_id%50 as int)-10 as cx, cast(event_id%70 as int)-5 as cy, cast(20+event_id%400 as int) as side
from {{events}}""",
    "windows": """
select c_custkey as frame_idx,
  case c_custkey%6 when 0 then 'MetaMask Notification' when 1 then concat('.ENV - proj',cast(c_nationkey as {STR}))
    when 2 then 'README.md - proj' when 3 then 'Windows PowerShell' when 4 then 'Discord - general' else 'my_wallet.dat' end as title,
  case c_nationkey%5 when 0 then 'Code.exe' when 1 then 'firefox.exe' when 2 then 'pwsh.exe' when 3 then 'Phantom.exe' else null end as process_name,
  cast(c_nationkey*10-60 as int) as "left", cast(c_custkey%300 as int) as top, cast(c_nationkey*10+500 as int) as "right", cast(c_custkey%300+400 as int) as bottom
from {customer}""",
    "sticky_hits": """
select user_id as stream_id, cast(row_number() over (partition by user_id order by ts, event_id)-1 as bigint) as frame_idx,
  (event_id*37)%12 as x, (event_id*53)%24 as y, 80+(event_id%6) as w, 20+(event_id%3) as h
from {events} where event_type in ('error','signup')""",
    "cells": """
select f.stream_id, f.frame_idx, cast(floor(c.cell/4.0) as int) as cy, cast(c.cell%4 as int) as cx,
  md5(concat(cast(f.stream_id as {STR}),'-',cast(c.cell as {STR}),'-',
    cast(case when c.cell < f.frame_idx%5 then f.frame_idx else cast(floor(f.frame_idx/7.0) as bigint) end as {STR}))) as hash
from (select user_id as stream_id, cast(row_number() over (partition by user_id order by ts, event_id)-1 as bigint) as frame_idx from {events}) f
cross join (select * from (values (0),(1),(2),(3),(4),(5),(6),(7)) t(cell)) c""",
    "pictures": """
select cast(n_regionkey as bigint) as stream_id, cast(n_nationkey as bigint) as frame_idx, cast(3+n_nationkey%5 as int) as width, cast(2+n_nationkey%4 as int) as height,
  substr(repeat(concat(md5(cast(n_nationkey as {STR})),md5(concat('x',cast(n_nationkey as {STR})))),5), 1, cast(8*(3+n_nationkey%5)*(2+n_nationkey%4) as int)) as hex
from {nation}""",
    "anchors": """
select vec_id%20 as frame_idx, vec_id as anchor, cast(320 as float)+{AT(1)}*cast(400 as float) as cx, cast(320 as float)+{AT(2)}*cast(400 as float) as cy,
  cast(40 as float)+abs({AT(3)})*cast(300 as float) as w, cast(40 as float)+abs({AT(4)})*cast(300 as float) as h,
  {LIST(}abs({AT(5)})*cast(2 as float),abs({AT(6)})*cast(2 as float),abs({AT(7)})*cast(2 as float),abs({AT(8)})*cast(2 as float),abs({AT(9)})*cast(2 as float),abs({AT(10)})*cast(2 as float){)} as scores
from {embeddings}""",
}


def sql(name: str, engine: str) -> str:
    """The fixture's text; Spark's keeps {table} where a table goes, DuckDB's has the table's name."""
    import re

    text = SQL[name]
    spark = engine == "spark"
    text = re.sub(r"\{AT\((\d+)\)\}", lambda m: f"element_at(embedding,{m[1]})" if spark else f"embedding[{m[1]}]", text)
    for k, s, d in (("{STR}", "string", "varchar"), ("{SHA}", "sha2", "sha256"), ("{BITS}", ",256", ""), ("{LIST(}", "array(", "["), ("{)}", ")", "]")):
        text = text.replace(k, s if spark else d)
    if spark:
        return text.replace('"left"', "`left`").replace('"right"', "`right`")
    return re.sub(r"\{(\w+)\}", r"\1", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame."""
    import re

    text = sql(name, "spark")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)
