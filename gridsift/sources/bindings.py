"""Screening inputs derived from the driver's tables: the same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HEIGHT = "(select cast(count(*)/100 as bigint) as h from orders)"

SQL = {
    "cells": f"""select k, r, c, cast(c as double) + cast(0.5 as double) as x, cast(h - r as double) - cast(0.5 as double) as y,
       case when hole then null else z end as z,
       case when hole then null else z + forest + shrub end as dsm
from (select k, r, c, h, r%75 between 40 and 42 and c between 55 and 58 as hole,
             cast(case when c between 45 and 54 and r%60 < 20 then 18 else 0 end as double) as forest,
             cast(case when k%251 = 0 then 2.5 else 0 end as double) as shrub,
             cast(100 as double) + cast(0.02 as double)*c + cast(0.01 as double)*r + cast(0.00000002 as double)*p
             + cast(0.167343 as double)*(case when c between 60 and 79 then c-60 when c >= 80 then 20 else 0 end)
             - cast(case when r%50 in (20,21) and c < 30 then 0.8 else 0 end as double) as z
      from (select o_orderkey as k, cast(floor(o_orderkey/100) as bigint) as r, o_orderkey%100 as c, o_totalprice as p, h
            from orders cross join {HEIGHT} hh) a) b""",
    "obstacles": f"""select s_suppkey as owner, cast((s_suppkey*37)%100 as double) + cast(0.25 as double) as x,
       cast((s_suppkey*53)%h as double) + cast(0.25 as double) as y,
       case when s_acctbal > 0 then cast(5 as double) + s_acctbal/200 else cast(30 as double) end as agl_m,
       s_acctbal <= 0 as assumed
from supplier cross join {HEIGHT} hh""",
    "points": """select c_custkey as id, cast((c_custkey*7919)%10007 as double)/10 as x, cast((c_custkey*104729)%10007 as double)/10 as y,
       c_acctbal as score from customer""",
    "polygons": f"""select cast(n_nationkey as bigint) as fid, cast(ring as bigint) as ring, cast(i as bigint) as i,
       cast((n_nationkey*41)%100 as double) + cast(case when ring=0 then 4 else 1.5 end as double)*dx as x,
       cast((n_nationkey*29)%h as double) + cast(case when ring=0 then 4 else 1.5 end as double)*dy as y
from nation cross join {HEIGHT} hh cross join (values (0),(1)) t(ring) cross join (values (0,-1,-1),(1,1,-1),(2,1,1),(3,-1,1)) v(i,dx,dy)""",
    "circles": f"""select cast(r_regionkey as bigint) as id, cast((r_regionkey*23)%100 as double) as x, cast((r_regionkey*31)%h as double) as y,
       cast(12 as double) as radius from region cross join {HEIGHT} hh""",
    "positions": """select s_suppkey as id, cast((s_suppkey*97)%1620 as double)/10 - 79 as lat, cast((s_suppkey*193)%3580 as double)/10 - 179 as lon from supplier""",
    "lines": """select cast(fid as bigint) as fid, cast(part as bigint) as part, cast(i as bigint) as i, cast(x as double) as x, cast(y as double) as y
from (values (0,0,0,10.5,5.5),(0,0,1,90.5,5.5),(1,0,0,5.5,1.5),(1,0,1,35.5,9.5),(2,0,0,60.5,2.5),(2,0,1,80.5,2.5),(2,0,2,80.5,8.5),(2,0,3,60.5,8.5),(2,0,4,60.5,2.5),(3,0,0,-50.5,-40.5),(3,0,1,-20.5,-40.5)) v(fid,part,i,x,y)""",
}
SQL["features"] = f"""select fid, 'area' as kind, ring as part, i, x, y, cast(8 + fid%5 as double) as agl_m from ({SQL["polygons"]}) p
union all select 1000 + owner, 'point', cast(0 as bigint), cast(0 as bigint), x, y, agl_m from ({SQL["obstacles"]}) o
union all select cast(500 + r_regionkey as bigint), 'line', cast(0 as bigint), cast(i as bigint), cast((r_regionkey*23)%70 as double) + cast(0.25 as double) + 27*i, cast((r_regionkey*31)%h as double) + cast(0.25 as double) + cast(4.5 as double)*i,
       cast(12 + r_regionkey as double) from region cross join {HEIGHT} hh cross join (values (0),(1)) v(i)"""
TABLES = {"features": ["nation", "region", "supplier", "orders"], "cells": ["orders"], "obstacles": ["supplier", "orders"], "points": ["customer"], "polygons": ["nation", "orders"], "circles": ["region", "orders"], "positions": ["supplier"], "lines": []}


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input of that name over the tables of sf_dir."""
    text, tables = SQL[name], {}
    for t in TABLES[name]:
        tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        text = text.replace(f"from {t} ", f"from {{{t}}} ").replace(f"from {t})", f"from {{{t}}})")
        if text.endswith(f"from {t}"):
            text = f"{text[: -len(t)]}{{{t}}}"
    return spark.sql(text, **tables)
