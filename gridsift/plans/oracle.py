"""DuckDB SQL for the queries: named common table expressions put together by need."""

from __future__ import annotations

import re

from gridsift.sources.bindings import SQL

# What holds for the small profile on 1 m cells: disks of radius 3 and 6, and the unions of rectangles in them.
_CTES: dict[str, tuple[tuple[str, ...], str]] = {name: ((), text) for name, text in SQL.items()}


def define(name: str, needs: tuple[str, ...], text: str) -> None:
    if name in _CTES:
        raise ValueError(f"{name} is defined twice")
    _CTES[name] = (needs, text)


def copy_of(name: str, renamed: dict[str, str]) -> None:
    """Define renamed[name]: the table expression name over other ones."""
    needs, text = _CTES[name]
    for old, new in renamed.items():
        text = re.sub(rf"\b{old}\b", new, text)
    define(renamed[name], tuple(renamed.get(n, n) for n in needs), text)


def sql(final: str, *needs: str) -> str:
    """final with all the table expressions that it needs, each after those it needs itself."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in _CTES[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return final
    head = ",\n".join(f"{name} as materialized (\n{_CTES[name][1]}\n)" for name in order)
    return f"with recursive {head}\n{final}"


define("disk3", (), "select dr, dc from range(-3, 4) a(dr) cross join range(-3, 4) b(dc) where dr*dr + dc*dc <= 9")
define("disk6", (), "select dr, dc, dr*dr + dc*dc > 9 as ring from range(-6, 7) a(dr) cross join range(-6, 7) b(dc) where dr*dr + dc*dc <= 36")
define("rects", (), "select r0, cast(floor(r0 * sin(radians(a)) + 1e-9) as bigint) as hh, cast(floor(r0 * cos(radians(a)) + 1e-9) as bigint) as hw from (values (3), (6)) t(r0) cross join range(0, 91, 15) u(a)")
define("union3", ("rects",), "select distinct dr, dc from rects cross join range(-3, 4) a(dr) cross join range(-3, 4) b(dc) where r0 = 3 and abs(dr) <= hh and abs(dc) <= hw")
define("union6", ("rects",), "select distinct dr, dc from rects cross join range(-6, 7) a(dr) cross join range(-6, 7) b(dc) where r0 = 6 and abs(dr) <= hh and abs(dc) <= hw")
define("ground_cells", ("cells",), "select *, z - 100 as zc, case when z is not null and dsm is not null then greatest(dsm - z, 0) end as hgt from cells")
define(
    "moments",
    ("ground_cells", "disk3"),
    """select c.r, c.c, any_value(c.zc) as zc, count(q.zc) as n, coalesce(sum(case when q.zc is not null then cast(dc as double) end), 0) as sx, coalesce(sum(case when q.zc is not null then cast(-dr as double) end), 0) as sy,
    coalesce(sum(case when q.zc is not null then cast(dc*dc as double) end), 0) as sxx, coalesce(sum(case when q.zc is not null then cast(dr*dr as double) end), 0) as syy, coalesce(sum(case when q.zc is not null then cast(-dr*dc as double) end), 0) as sxy,
    coalesce(sum(q.zc), 0) as sz, coalesce(sum(dc*q.zc), 0) as sxz, coalesce(sum(-dr*q.zc), 0) as syz, coalesce(sum(q.zc*q.zc), 0) as szz, count(q.hgt) as pad_seen, max(q.hgt) as pad_max
  from ground_cells c cross join disk3 left join ground_cells q on q.r = c.r + dr and q.c = c.c + dc group by c.r, c.c""",
)
_SOLVE = """select *, degrees(atan(sqrt(a*a + b*b))) as slope,
    case when sqrt(a*a + b*b) > 1e-6 then (((degrees(atan2(-a, -b)) + 360) % 360) + 360) % 360 end as aspect,
    case when det is not null then sqrt(greatest(szz - a*sxz - b*syz - c0*sz, 0) / greatest(n, 1)) end as rms
  from (select *,
      (sxz*(syy*n - sy*sy) - sxy*(syz*n - sy*sz) + sx*(syz*sy - syy*sz)) / det as a,
      (sxx*(syz*n - sy*sz) - sxz*(sxy*n - sy*sx) + sx*(sxy*sz - syz*sx)) / det as b,
      (sxx*(syy*sz - syz*sy) - sxy*(sxy*sz - syz*sx) + sxz*(sxy*sy - syy*sx)) / det as c0
    from (select *, case when zc is not null and n >= 3 and abs(d0) > 1e-9 * greatest(sxx*syy*greatest(n, 1), 1e-30) then d0 end as det
      from (select *, sxx*(syy*n - sy*sy) - sxy*(sxy*n - sy*sx) + sx*(sxy*sy - syy*sx) as d0 from {source}) m0) m1) m2"""
define("planes", ("moments",), _SOLVE.format(source="moments"))
define("micro", ("planes", "union3"), "select p.r, p.c, max(case when q.slope is not null then abs(q.zc - q.c0) else 0 end) as micro from planes p cross join union3 join planes q on q.r = p.r + dr and q.c = p.c + dc group by p.r, p.c")
define("pad_max", ("ground_cells", "union3"), "select p.r, p.c, max(q.hgt) as tdp_obstacle from ground_cells p cross join union3 join ground_cells q on q.r = p.r + dr and q.c = p.c + dc group by p.r, p.c")
define("area_max", ("ground_cells", "union6"), "select p.r, p.c, max(q.hgt) as area_obstacle from ground_cells p cross join union6 join ground_cells q on q.r = p.r + dr and q.c = p.c + dc group by p.r, p.c")
define("area_seen", ("ground_cells", "disk6"), "select p.r, p.c, count(case when ring then q.hgt end) as ring_seen, (select count(*) from disk6 where ring) as ring_cells from ground_cells p cross join disk6 join ground_cells q on q.r = p.r + dr and q.c = p.c + dc group by p.r, p.c")
define(
    "terrain",
    ("planes", "micro", "pad_max", "area_max", "area_seen", "ground_cells"),
    """select p.r, p.c, p.zc, g.hgt as h, g.dsm, slope, aspect, rms, case when slope is not null then greatest(micro, 1.4 * rms) end as roughness,
    case when p.zc is not null then n / 29.0 else 0 end as valid_fraction, tdp_obstacle, area_obstacle, pad_seen / 29.0 as tdp_coverage, coalesce(ring_seen, 0) / cast(coalesce(ring_cells, 84) as double) as area_coverage
  from planes p join ground_cells g using (r, c) left join micro using (r, c) left join pad_max using (r, c) left join area_max using (r, c) left join area_seen using (r, c)""",
)
define(
    "classes",
    ("terrain",),
    """select *, case when reason = 255 then 255 when reason = 0 then 1 when reason = 1 then 2 else 0 end as ground from (select *, case
      when zc is null then 255
      when not coalesce(slope is not null and roughness is not null and valid_fraction >= 0.95, false) then 2
      when not coalesce(slope <= 10, false) then 3
      when not coalesce(roughness <= 0.3, false) then 4
      when not coalesce(tdp_coverage >= 0.95 and area_coverage >= 0.9, false) then 5
      when not coalesce(tdp_obstacle <= 0.3, false) then 6
      when not coalesce(area_obstacle <= 1, false) then 7
      when slope <= 6 then 0 else 1 end as reason from terrain) t""",
)
SOLVE = _SOLVE
define(
    "exact_moments",
    ("classes", "ground_cells", "disk6"),
    """select p.r, p.c, max(case when dr = 0 and dc = 0 then q.zc end) as zc, count(case when not ring then q.zc end) as n,
    coalesce(sum(case when not ring and q.zc is not null then cast(dc as double) end), 0) as sx, coalesce(sum(case when not ring and q.zc is not null then cast(-dr as double) end), 0) as sy,
    coalesce(sum(case when not ring and q.zc is not null then cast(dc*dc as double) end), 0) as sxx, coalesce(sum(case when not ring and q.zc is not null then cast(dr*dr as double) end), 0) as syy,
    coalesce(sum(case when not ring and q.zc is not null then cast(-dr*dc as double) end), 0) as sxy, coalesce(sum(case when not ring then q.zc end), 0) as sz, coalesce(sum(case when not ring then dc*q.zc end), 0) as sxz,
    coalesce(sum(case when not ring then -dr*q.zc end), 0) as syz, coalesce(sum(case when not ring then q.zc*q.zc end), 0) as szz,
    max(case when not ring then q.hgt end) as tdp_obstacle, max(case when ring then q.hgt end) as ring_obstacle, count(case when not ring then q.hgt end) as pad_seen, count(case when ring then q.hgt end) as ring_seen
  from (select r, c from classes where ground in (1, 2)) p cross join disk6 join ground_cells q on q.r = p.r + dr and q.c = p.c + dc group by p.r, p.c""",
)
define("exact_planes", ("exact_moments",), _SOLVE.format(source="exact_moments"))
define("exact_residual", ("exact_planes", "ground_cells", "disk3"), "select p.r, p.c, max(abs(q.zc - (p.a*dc + p.b*(-dr) + p.c0))) as residual from exact_planes p cross join disk3 join ground_cells q on q.r = p.r + dr and q.c = p.c + dc where q.zc is not null group by p.r, p.c")
define(
    "exact",
    ("exact_planes", "exact_residual"),
    """select p.r, p.c, zc, slope, aspect, residual, n / 29.0 as valid_fraction, tdp_obstacle, ring_obstacle, pad_seen / 29.0 as tdp_coverage, ring_seen / 84.0 as ring_coverage
  from exact_planes p left join exact_residual using (r, c)""",
)
