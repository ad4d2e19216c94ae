"""Scalar classifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import half_up

# Receiver brands by grade.
SURVEY = ("LEICA", "TRIMBLE", "SEPT", "SEPTENTRIO", "NOVATEL", "JAVAD", "TOPCON", "SOKKIA", "GEO++", "GEOPP", "CHCNAV", "CHC")
PROFESSIONAL = ("STONEX", "SOUTH", "KOLIDA", "FOIF", "RUIDE", "SANDING", "TERSUS", "UNICORE")
CONSUMER = ("U-BLOX", "UBLOX", "F9P", "ZED-F9P", "SPARKFUN", "ARDUSIMPLE")
INFERRED = (("SURVEY_GRADE_INFERRED", "survey_grade", 0.75), ("PROFESSIONAL_INFERRED", "professional", 0.65),
            ("CONSUMER_GOOD_INFERRED", "consumer", 0.5), ("CONSUMER_BASIC_INFERRED", "consumer", 0.3))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def classify_hardware(receiver: Column, antenna: Column) -> Column:
    """Struct ``hardware_class, confidence`` of a receiver and antenna name; the order of the rules matters."""
    text = F.upper(F.concat_ws(" ", F.coalesce(receiver, F.lit("")), F.coalesce(antenna, F.lit(""))))
    grade = lambda name, sure: F.struct(F.lit(name).alias("hardware_class"), F.lit(sure).alias("confidence"))
    out = F.when(any_of(text, SURVEY), grade("survey_grade", 0.95)).when(any_of(text, PROFESSIONAL), grade("professional", 0.8)).when(
        any_of(text, CONSUMER), grade("consumer", 0.5))
    for mark, name, sure in INFERRED:
        out = out.when(text.contains(mark), grade(name, sure))
    return out.otherwise(grade("unknown", 0.2))


def infer_receiver_class(fmt: Column, nav: Column, carrier: Column, generator: Column) -> Column:
    """Receiver grade from a sourcetable line; a named generator is taken as it is."""
    systems = F.when(F.coalesce(nav, F.lit("")) == "", 0).otherwise(F.size(F.split(nav, r"\+")))
    details = F.coalesce(fmt, F.lit(""))
    msm7, msm5 = any_of(details, ("1077", "1087")), any_of(details, ("1075", "1085"))
    return (F.when(F.coalesce(generator, F.lit("")) != "", generator).when(msm7 & (systems >= 4) & (carrier >= 4), "SURVEY_GRADE_INFERRED")
            .when(msm7 & (systems >= 3), "PROFESSIONAL_INFERRED").when(msm5 | (msm7 & (systems >= 2)), "CONSUMER_GOOD_INFERRED").otherwise("CONSUMER_BASIC_INFERRED"))


def hardware_report_class(receiver: Column) -> Column:
    """Seven-way class for counts."""
    has = lambda *w: any_of(receiver, w)
    return (F.when(receiver.isNull() | (receiver == ""), "unknown").when(has("LEICA", "TRIMBLE", "SEPT", "NOVATEL", "CHC", "TOPCON"), "survey_grade_exact")
            .when(has("SURVEY_GRADE_PROBED"), "survey_grade_probed").when(has("SURVEY_GRADE_INFERRED"), "survey_grade_inferred").when(has("PROFESSIONAL"), "professional")
            .when(has("CONSUMER", "U-BLOX", "F9P"), "consumer").otherwise("other"))


def flare_class(flux: Column) -> Column:
    """X-ray flux as a class letter with its one-decimal scale; weak flux has none."""
    scale = lambda letter, unit: F.concat(F.lit(letter), F.format_string("%.1f", half_up(flux / unit, 1)))
    return F.when(flux >= 1e-4, scale("X", 1e-4)).when(flux >= 1e-5, scale("M", 1e-5)).when(flux >= 1e-6, scale("C", 1e-6))


def kp_from_cme_speed(speed: Column) -> Column:
    out = F.lit(3)
    for bound, kp in ((400, 4), (600, 5), (800, 6), (1000, 7), (1500, 8), (2000, 9)):
        out = F.when(speed >= bound, kp).otherwise(out)
    return out


def storm_impact_kp(kp: Column) -> Column:
    """Struct ``level, impact_pct`` from Kp alone. The bands test exact numbers, so a fractional Kp above 3 that is no
    whole number falls through to the last band."""
    level = (F.when(kp < 4, "none").when(kp == 4, "minor").when(kp == 5, "moderate").when(kp == 6, "strong").when(kp.isin(7, 8), "severe").otherwise("extreme"))
    pct = F.when(kp <= 3, 0).when(kp == 4, -5).when(kp == 5, -12).when(kp == 6, -25).otherwise(-40)
    return F.struct(level.alias("level"), pct.alias("impact_pct"))


def storm_impact(kp: Column, dst: Column, bz: Column, xray: Column) -> Column:
    """Struct ``level, phase, impact_pct, regions`` from four indicators."""
    level = (F.when((kp >= 8) | (dst < -200) | (xray >= 1e-4), "extreme").when((kp >= 7) | (dst < -100), "severe").when((kp >= 6) | (dst < -50), "strong")
             .when((kp >= 5) | (dst < -30), "moderate").when((kp >= 4) | (dst < -20), "minor").otherwise("quiet"))
    phase = F.when((dst < -30) & (bz < -5), "main").when((dst < -20) & (bz > 0), "recovery").when(bz < -10, "initial").otherwise("quiet")
    base = F.when(level == "extreme", -50).when(level == "severe", -35).when(level == "strong", -25).when(level == "moderate", -12).when(level == "minor", -5).otherwise(0)
    names = lambda *r: F.array(*[F.lit(x) for x in r])
    some, more = names("EU North", "Canada"), names("EU Central", "US East", "South America")
    most = names("EU West", "US Central", "US West", "Australia", "Asia Pacific")
    regions = (F.when(level == "quiet", F.array().cast("array<string>")).when(level == "minor", some).when(level == "moderate", F.concat(some, more))
               .otherwise(F.concat(some, more, most)))
    return F.struct(level.alias("level"), phase.alias("phase"), (base + F.when(xray >= 1e-4, -15).when(xray >= 1e-5, -5).otherwise(0)).alias("impact_pct"), regions.alias("regions"))


def tropo_risk(humidity: Column, rain: Column) -> Column:
    return F.when((humidity > 85) & (rain > 2), "high").when((humidity > 70) | (rain > 0.5), "medium").otherwise("low")


def tropo_delay(pressure: Column, temp_c: Column, humidity: Column, lat: Column, height_m: Column) -> Column:
    """Zenith and slant delays in metres (Saastamoinen), error of a 50 km baseline in millimetres, and risk."""
    dry = 0.0022768 * pressure / (1 - 0.00266 * F.cos(2 * F.radians(lat)) - 0.00028 * height_m / 1000)
    vapour = humidity / 100 * 6.1078 * F.pow(F.lit(10.0), 7.5 * temp_c / (237.3 + temp_c))
    wet = 0.002277 * (1255 / (temp_c + 273.15) + 0.05) * vapour
    low = F.radians(F.lit(10.0))
    mapping = 1 / (F.sin(low) + 0.00143 / (F.tan(low) + 0.0445))
    risk = F.when((wet < 0.1) & (humidity < 60), "low").when((wet < 0.2) | (humidity < 80), "medium").otherwise("high")
    return F.struct(half_up(dry, 4).alias("dry_m"), half_up(wet, 4).alias("wet_m"), half_up(dry + wet, 4).alias("total_m"), half_up((dry + wet) * mapping, 3).alias("slant_m"),
                    half_up(wet * 1000 * (50 / 75) * 0.1, 1).alias("baseline_error_mm"), risk.alias("risk"))


def magnetic_latitude(lat: Column, lon: Column, pole_lat: float = 86.5, pole_lon: float = -164.0) -> Column:
    """Latitude in the tilted dipole."""
    p = F.radians(F.lit(pole_lat))
    x = F.sin(F.radians(lat)) * F.sin(p) + F.cos(F.radians(lat)) * F.cos(p) * F.cos(F.radians(lon - pole_lon))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))))


def iono_sigma(vtec: Column, gradient: Column, km: Column, dual: bool) -> Column:
    """Ionospheric error of a baseline: by gradient for dual-frequency receivers, by content for single-frequency ones (L1)."""
    return gradient * km * 0.001 if dual else 0.4 * vtec / F.lit(1575.42**2) * 1e6
