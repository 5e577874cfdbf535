"""Points, distances and travel time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius, WGS-84 axes (m), flight speed (km/h)
EARTH_RADIUS, AXIS_A, FLATTENING, SPEED = 6371008.8, 6378137.0, 1 / 298.257223563, 800.0


def point_lon_lat(geojson: Column) -> tuple[Column, Column]:
    """GeoJSON point text to longitude and latitude."""
    p = F.from_json(geojson, "struct<type:string,coordinates:array<double>>")["coordinates"]
    return F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)
    )
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


#: Steps after which an ellipsoidal distance is given up, and the change of angle that ends it before.
STEPS, ANGLE = 200, 1e-12


def ellipsoidal(lon1: Column, lat1: Column, lon2: Column, lat2: Column, steps: int = STEPS) -> Column:
    """Vincenty inverse distance in metres, all in columns.

    The iteration ends when the angle changes by less than ANGLE. Nearly antipodal points,
    for which it never settles, give null, as missing coordinates do; see `ellipsoidal_settles`.
    """
    return _ellipsoidal(lon1, lat1, lon2, lat2, steps)["metres"]


def ellipsoidal_settles(lon1: Column, lat1: Column, lon2: Column, lat2: Column, steps: int = STEPS) -> Column:
    """Whether the ellipsoidal distance of two points is found; null where a coordinate is missing."""
    return _ellipsoidal(lon1, lat1, lon2, lat2, steps)["settled"]


def _ellipsoidal(lon1: Column, lat1: Column, lon2: Column, lat2: Column, steps: int) -> Column:
    f, a = FLATTENING, AXIS_A
    b = a * (1 - f)
    u1, u2 = (F.atan(F.lit(1 - f) * F.tan(F.radians(x))) for x in (lat1, lat2))
    turn = F.radians(lon2 - lon1)
    ell = turn - F.lit(2 * math.pi) * F.round(turn / F.lit(2 * math.pi))  # the shorter way round

    def at(lam: Column, s: Column) -> dict[str, Column]:
        su1, cu1, su2, cu2 = s["su1"], s["cu1"], s["su2"], s["cu2"]
        sin_sig = F.sqrt(F.pow(cu2 * F.sin(lam), F.lit(2.0)) + F.pow(cu1 * su2 - su1 * cu2 * F.cos(lam), F.lit(2.0)))
        cos_sig = su1 * su2 + cu1 * cu2 * F.cos(lam)
        sin_al = F.coalesce(F.try_divide(cu1 * cu2 * F.sin(lam), sin_sig), F.lit(0.0))
        cos2_al = 1 - sin_al * sin_al
        cos_2m = F.coalesce(cos_sig - F.try_divide(F.lit(2.0) * su1 * su2, cos2_al), F.lit(0.0))
        return {"sin_sig": sin_sig, "cos_sig": cos_sig, "sin_al": sin_al, "cos2_al": cos2_al, "cos_2m": cos_2m}

    base = [F.sin(u1).alias("su1"), F.cos(u1).alias("cu1"), F.sin(u2).alias("su2"), F.cos(u2).alias("cu2"), ell.alias("ell")]

    def step(s: Column, _: Column) -> Column:
        # each step stores the angles first, so later terms read fields instead of repeating them
        v = s["v"]
        sig = F.atan2(v["sin_sig"], v["cos_sig"])
        c = F.lit(f / 16) * v["cos2_al"] * (4 + F.lit(f) * (4 - 3 * v["cos2_al"]))
        lam = s["ell"] + (1 - c) * F.lit(f) * v["sin_al"] * (
            sig + c * v["sin_sig"] * (v["cos_2m"] + c * v["cos_sig"] * (2 * v["cos_2m"] * v["cos_2m"] - 1))
        )
        done = (F.abs(lam - s["lam"]) < ANGLE) & (F.abs(lam) <= math.pi)
        return F.struct(*[s[k].alias(k) for k in ("su1", "cu1", "su2", "cu2", "ell")], lam.alias("lam"), s["v"].alias("v"), done.alias("done"))

    def settle(s: Column, _: Column) -> Column:
        v = F.struct(*[x.alias(k) for k, x in at(s["lam"], s).items()])
        return F.struct(*[s[k].alias(k) for k in ("su1", "cu1", "su2", "cu2", "ell", "lam")], v.alias("v"), s["done"].alias("done"))

    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("sin_sig", "cos_sig", "sin_al", "cos2_al", "cos_2m")])
    start = F.struct(*base, ell.alias("lam"), zero.alias("v"), F.when(ell.isNotNull(), False).alias("done"))
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(2 * steps + 1)),
        start,
        lambda s, i: F.when(s["done"], s).when(i % 2 == 1, settle(s, i)).otherwise(step(s, i)),
    )

    def length(v: Column) -> Column:
        u_sq = v["cos2_al"] * F.lit((a * a - b * b) / (b * b))
        big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
        big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
        d_sig = big_b * v["sin_sig"] * (
            v["cos_2m"]
            + big_b / 4 * (
                v["cos_sig"] * (2 * v["cos_2m"] * v["cos_2m"] - 1)
                - big_b / 6 * v["cos_2m"] * (4 * v["sin_sig"] * v["sin_sig"] - 3) * (4 * v["cos_2m"] * v["cos_2m"] - 3)
            )
        )
        return F.lit(b) * big_a * (F.atan2(v["sin_sig"], v["cos_sig"]) - d_sig)

    known = F.transform(F.array(state), lambda s: F.struct(F.when(s["done"], length(s["v"])).alias("metres"), s["done"].alias("settled")))
    return known[0]


def travel_hours(metres: Column) -> Column:
    """Hours in the air at the fixed speed."""
    return metres / F.lit(1000.0) / F.lit(SPEED)
