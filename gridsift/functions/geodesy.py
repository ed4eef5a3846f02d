"""Geodesy as SQL expressions: plain arithmetic that stays in the JVM, and that DuckDB reads as well.

Each function takes SQL text and returns SQL text. Positions are WGS 84 degrees, UTM in metres.
"""

from __future__ import annotations

# WGS 84, the UTM scale and the letters of the military grid.
A, F_INV, K0 = 6378137.0, 298.257223563, 0.9996
E2 = (2 - 1 / F_INV) / F_INV
EP2 = E2 / (1 - E2)
BANDS = "CDEFGHJKLMNPQRSTUVWX"
COLUMNS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
ROWS = "ABCDEFGHJKLMNPQRSTUV"


def _d(x: float) -> str:
    return f"cast({x!r} as double)"


def zone(lat: str, lon: str) -> str:
    """UTM zone with the exceptions of Norway and Svalbard."""
    turned = f"((({lon} + 180) % 360 + 360) % 360 - 180)"
    return (
        f"cast(case when {lat} >= 72 and {lat} <= 84 and {turned} >= 0 and {turned} < 9 then 31 when {lat} >= 72 and {lat} <= 84 and {turned} >= 9 and {turned} < 21 then 33 "
        f"when {lat} >= 72 and {lat} <= 84 and {turned} >= 21 and {turned} < 33 then 35 when {lat} >= 72 and {lat} <= 84 and {turned} >= 33 and {turned} < 42 then 37 "
        f"when {lat} >= 56 and {lat} < 64 and {turned} >= 3 and {turned} < 12 then 32 else least(60, greatest(1, floor(({turned} + 180) / 6) + 1)) end as bigint)"
    )


def band(lat: str) -> str:
    """Latitude band letter; empty beyond 80 S and 84 N."""
    return f"case when {lat} < -80 or {lat} > 84 then '' else substr('{BANDS}', cast(least(19, floor(({lat} + 80) / 8)) as int) + 1, 1) end"


def _arc(phi: str) -> str:
    """Meridian arc from the equator."""
    e4, e6 = E2 * E2, E2**3
    return f"({_d(A)} * ({_d(1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256)} * {phi} - {_d(3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024)} * sin(2 * {phi}) + {_d(15 * e4 / 256 + 45 * e6 / 1024)} * sin(4 * {phi}) - {_d(35 * e6 / 3072)} * sin(6 * {phi})))"


def to_utm(lat: str, lon: str, zone_text: str) -> tuple[str, str]:
    """Easting and northing by the usual series."""
    phi = f"radians({lat})"
    n = f"({_d(A)} / sqrt(1 - {_d(E2)} * sin({phi}) * sin({phi})))"
    t, c = f"(tan({phi}) * tan({phi}))", f"({_d(EP2)} * cos({phi}) * cos({phi}))"
    a = f"((radians({lon}) - radians(cast(({zone_text} - 1) * 6 - 177 as double))) * cos({phi}))"
    east = f"({_d(K0)} * {n} * ({a} + (1 - {t} + {c}) * pow({a}, 3) / 6 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - {_d(58 * EP2)}) * pow({a}, 5) / 120) + 500000)"
    north = f"({_d(K0)} * ({_arc(phi)} + {n} * tan({phi}) * ({a} * {a} / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * pow({a}, 4) / 24 + (61 - 58 * {t} + {t} * {t} + 600 * {c} - {_d(330 * EP2)}) * pow({a}, 6) / 720)) + case when {lat} < 0 then 10000000 else 0 end)"
    return east, north


def from_utm(zone_text: str, is_north: str, east: str, north: str) -> tuple[str, str]:
    """Latitude and longitude by the inverse series."""
    e1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
    y = f"({north} - case when {is_north} then 0 else 10000000 end)"
    mu = f"({y} / {_d(K0 * A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))})"
    foot = f"({mu} + {_d(1.5 * e1 - 27 * e1**3 / 32)} * sin(2 * {mu}) + {_d(21 * e1**2 / 16 - 55 * e1**4 / 32)} * sin(4 * {mu}) + {_d(151 * e1**3 / 96)} * sin(6 * {mu}) + {_d(1097 * e1**4 / 512)} * sin(8 * {mu}))"
    return foot, f"(({east} - 500000) / {_d(K0)})"


def from_utm_steps(zone_text: str, foot: str, x: str) -> tuple[str, str]:
    """Latitude and longitude from the two columns that from_utm gives."""
    c, t = f"({_d(EP2)} * cos({foot}) * cos({foot}))", f"(tan({foot}) * tan({foot}))"
    w = f"(1 - {_d(E2)} * sin({foot}) * sin({foot}))"
    n, r = f"({_d(A)} / sqrt({w}))", f"({_d(A * (1 - E2))} / pow({w}, 1.5))"
    d = f"({x} / {n})"
    lat = f"degrees({foot} - ({n} * tan({foot}) / {r}) * ({d} * {d} / 2 - (5 + 3 * {t} + 10 * {c} - 4 * {c} * {c} - {_d(9 * EP2)}) * pow({d}, 4) / 24 + (61 + 90 * {t} + 298 * {c} + 45 * {t} * {t} - {_d(252 * EP2)} - 3 * {c} * {c}) * pow({d}, 6) / 720))"
    lon = f"(cast(({zone_text} - 1) * 6 - 177 as double) + degrees(({d} - (1 + 2 * {t} + {c}) * pow({d}, 3) / 6 + (5 - 2 * {c} + 28 * {t} - 3 * {c} * {c} + {_d(8 * EP2)} + 24 * {t} * {t}) * pow({d}, 5) / 120) / cos({foot})))"
    return lat, lon


def mgrs(zone_text: str, band_text: str, east: str, north: str, digits: int = 5) -> str:
    """Grid reference with so many digits each way; empty where there is none."""
    column = f"cast(floor({east} / 100000) as int)"
    row = f"cast((floor({north} / 100000) + case when {zone_text} % 2 = 0 then 5 else 0 end) % 20 as int)"
    number = lambda v: f"lpad(cast(cast(floor(({v} % 100000) / {10 ** (5 - digits)}) as bigint) as varchar({digits + 5})), {digits}, '0')"
    letters = f"substr('{COLUMNS}', cast((({zone_text} - 1) % 3) * 8 as int) + {column}, 1)"
    return f"case when {band_text} = '' or {column} < 1 or {column} > 8 then '' else concat(lpad(cast({zone_text} as varchar(3)), 2, '0'), {band_text}, ' ', {letters}, substr('{ROWS}', {row} + 1, 1), ' ', {number(east)}, ' ', {number(north)}) end"


def epsg(lat: str, lon: str, nad83: str) -> str:
    """EPSG code of the plain UTM zone: NAD 83 where it is kept (zones 1 to 23 north), else WGS 84; null beyond UTM."""
    plain = f"least(60, greatest(1, floor((((({lon} + 180) % 360 + 360) % 360)) / 6) + 1))"
    return f"cast(case when {lat} < -80 or {lat} > 84 then null when {nad83} and {lat} >= 0 and {plain} <= 23 then 26900 + {plain} when {lat} >= 0 then 32600 + {plain} else 32700 + {plain} end as bigint)"


def metres_per_degree(lat: str) -> tuple[str, str]:
    """Metres per degree of longitude and of latitude."""
    phi = f"radians({lat})"
    return f"(111412.84 * cos({phi}) - 93.5 * cos(3 * {phi}) + 0.118 * cos(5 * {phi}))", f"(111132.954 - 559.822 * cos(2 * {phi}) + 1.175 * cos(4 * {phi}))"


def utm_of_epsg(code: str) -> str:
    """Zone with hemisphere, such as 18N, of a UTM code; null for any other."""
    return f"case when {code} between 32601 and 32660 then concat(cast({code} - 32600 as varchar(3)), 'N') when {code} between 32701 and 32760 then concat(cast({code} - 32700 as varchar(3)), 'S') when {code} between 26901 and 26923 then concat(cast({code} - 26900 as varchar(3)), 'N') end"


def compass(bearing: str, points: int = 16) -> str:
    """Name of the nearest of 8 or 16 compass points."""
    names = "N   NNE NE  ENE E   ESE SE  SSE S   SSW SW  WSW W   WNW NW  NNW "
    step = 360 / points
    return f"trim(substr('{names}', cast(cast(floor(({bearing} + {step / 2}) / {step}) as bigint) % {points} as int) * {4 * (16 // points)} + 1, 4))"
