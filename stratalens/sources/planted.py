"""A synthetic set of the case tables with planted patterns, by rules over row numbers.

Every value is a hash of a row number and a salt, so the tables are the same at each run and
on any cluster. Background cases are spread over places, kinds and days; what the operators
must find is planted on top.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .schemas import SPECS

# The planted patterns.
ANCHOR, HISTORY_DAYS = "2026-07-01", 1095
DISTRICTS = (44, 12, 20, 9, 1, 2, 3, 4, 5, 6, 7, 8)
HOT = {"unit": 4430, "lat": 13.0310, "lon": 77.5185, "radius_m": 700, "kind": 71, "cases": 60, "days": 90}
SPIKE = {"unit": 4430, "kind": 71, "weekly": 4, "extra": 22, "days": 14}
SCHEME_CASES = 25
FRAGMENT = (("Ravi Kumar", 29, 44), ("Ravi K", 30, 12), ("Ravi Kumar S", 30, 20))
NAMESAKES = (("Suresh Babu", 24, 44), ("Suresh Babu", 52, 9))
ODD = {"unit": 4432, "kind": 71, "hour": 4, "accused": 6}
NO_PLACE, NO_AGE, WRONG_COURTS, WRONG_COURT = 0.04, 0.08, 5, 9999

FIRST = "Anil Bharat Chetan Deepak Ganesh Harish Imran Jagdish Kiran Lokesh Mahesh Naveen Prakash Rakesh Sanjay Tejas Umesh Vijay Asha Divya Kavya Meena Nisha Pooja".split()
LAST = "Gowda Patil Naik Hegde Shetty Reddy Desai Joshi Pai Bhat Rao Menon".split()
HEADS = ("Offences against property", "Offences against persons", "Public order", "Economic offences", "Robbery and theft", "Other offences")


def draw(n: int, *key) -> Column:
    """A number below ``n`` from a hash of the key."""
    return F.pmod(F.xxhash64(*(F.lit(k) if isinstance(k, (str, int)) else k for k in key)), F.lit(n)).cast("long")


def _narrative(kind: Column) -> Column:
    return F.format_string("The complainant reported an incident of kind %d during the day; enquiries go on.", kind)


def _cases(spark: SparkSession, background: int) -> DataFrame:
    """``n`` from 1, with unit, kind, days ago, hour, place, narrative and accused."""
    i = F.col("id")
    unit = F.element_at(F.array(*map(F.lit, DISTRICTS)), (draw(12, i, "district") + 1).cast("int")) * 100 + 30 + draw(3, i, "unit")
    kind = (draw(6, i, "head") + 3) * 10 + 1 + draw(5, i, "kind")
    spread = lambda centre, salt: F.lit(centre) + (draw(200_001, i, salt) - 100_000) / F.lit(200_000.0)
    plain = spark.range(background).select(unit.alias("unit"), kind.cast("long").alias("kind"), draw(HISTORY_DAYS, i, "day").alias("ago"), (9 + draw(9, i, "hour")).alias("hour"), spread(13.0, "lat").alias("lat"), spread(77.5, "lon").alias("lon"), _narrative(kind).alias("narrative"), (1 + draw(2, i, "accused")).alias("accused"), F.lit("background").alias("plan"), i.alias("k"))

    def near(salt):
        far, way = F.sqrt(draw(10_001, i, salt, "r") / F.lit(10_000.0)) * HOT["radius_m"], F.radians(draw(360, i, salt, "w").cast("double"))
        return F.lit(HOT["lat"]) + F.degrees(far * F.sin(way) / 6_371_000), F.lit(HOT["lon"]) + F.degrees(far * F.cos(way) / 6_371_000) / F.cos(F.radians(F.lit(HOT["lat"])))

    lat, lon = near("hot")
    scheme = F.lit("Two men riding a motorcycle came from behind and snatched the gold chain of the complainant at night, and sped away towards the ring road.")
    same = lambda unit, kind: (F.lit(unit).cast("long").alias("unit"), F.lit(kind).cast("long").alias("kind"))
    hot = spark.range(0, HOT["cases"], 1, 1).select(*same(HOT["unit"], HOT["kind"]), draw(HOT["days"], i, "hotday").alias("ago"), F.pmod(21 + draw(6, i, "hothour"), F.lit(24)).alias("hour"), lat.alias("lat"), lon.alias("lon"), F.when(i < SCHEME_CASES, scheme).otherwise(_narrative(F.lit(HOT["kind"]))).alias("narrative"), F.lit(2).cast("long").alias("accused"), F.lit("hotspot").alias("plan"), i.alias("k"))

    def steady(n, ago, plan):
        return spark.range(0, n, 1, 1).select(*same(SPIKE["unit"], SPIKE["kind"]), ago.cast("long").alias("ago"), (9 + draw(9, i, plan)).alias("hour"), spread(13.0, plan + "lat").alias("lat"), spread(77.5, plan + "lon").alias("lon"), _narrative(F.lit(SPIKE["kind"])).alias("narrative"), F.lit(1).cast("long").alias("accused"), F.lit(plan).alias("plan"), i.alias("k"))

    weekly = steady(SPIKE["weekly"] * 26, F.floor(i / SPIKE["weekly"]) * 7 + i % SPIKE["weekly"], "weekly")
    spike = steady(SPIKE["extra"], i % SPIKE["days"], "spike")
    one = lambda unit, kind, plan, hour=11, accused=1: spark.range(0, 1, 1, 1).select(*same(unit, kind), F.lit(5).cast("long").alias("ago"), F.lit(hour).cast("long").alias("hour"), F.lit(13.3).alias("lat"), F.lit(77.9).alias("lon"), _narrative(F.lit(kind)).alias("narrative"), F.lit(accused).cast("long").alias("accused"), F.lit(plan).alias("plan"), i.alias("k"))
    single = [one(d * 100 + 31, 35, f"person {k}") for k, (_, _, d) in enumerate(FRAGMENT + NAMESAKES)] + [one(ODD["unit"], ODD["kind"], "odd", ODD["hour"], ODD["accused"])]
    # numbers: background first, then each plan behind the one before
    out, start = [], 1
    for part, n in [(plain, background), (hot, HOT["cases"]), (weekly, SPIKE["weekly"] * 26), (spike, SPIKE["extra"]), *((s, 1) for s in single)]:
        out.append(part.withColumn("n", F.col("k") + start))
        start += n
    return reduce(DataFrame.unionByName, out)


def planted_tables(spark: SparkSession, background: int = 16_000) -> dict[str, DataFrame]:
    """Name -> DataFrame with the columns of the schemas; lookups that no operator reads
    are short."""
    c, t = _cases(spark, background), {}
    day = F.date_sub(F.lit(ANCHOR).cast("date"), F.col("ago").cast("int"))
    start = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour").cast("int"))
    hidden = (F.col("plan") == "background") & (draw(10_000, F.col("k"), "noplace") < NO_PLACE * 10_000)
    court = F.when((F.col("plan") == "background") & (F.col("k") < WRONG_COURTS), WRONG_COURT).otherwise(F.floor(F.col("unit") / 100))
    filled = {
        "CaseMasterID": F.col("n"), "CrimeNo": F.format_string("%09d", "n"), "CaseNo": F.format_string("%05d", F.col("n") % 100_000), "CrimeRegisteredDate": day, "PoliceStationID": F.col("unit"),
        "PolicePersonID": F.col("unit"), "CaseCategoryID": 1 + draw(4, F.col("n"), "category"), "GravityOffenceID": 1 + draw(2, F.col("n"), "gravity"), "CrimeMajorHeadID": F.floor(F.col("kind") / 10), "CrimeMinorHeadID": F.col("kind"),
        "CaseStatusID": 1 + draw(3, F.col("n"), "status"), "CourtID": court, "IncidentFromDate": start, "IncidentToDate": start, "InfoReceivedPSDate": start, "latitude": F.when(~hidden, F.col("lat")), "longitude": F.when(~hidden, F.col("lon")), "BriefFacts": F.col("narrative"),
    }
    t["CaseMaster"] = c.select(*(v.alias(k) for k, v in filled.items()))

    def name(salt):
        pick = lambda names, s: F.element_at(F.array(*map(F.lit, names)), (draw(len(names), F.col("n"), F.col("j"), salt, s) + 1).cast("int"))
        return F.concat_ws(" ", pick(FIRST, "f"), pick(LAST, "l"))

    known = F.element_at(F.create_map(*(x for k, (text, age, _) in enumerate(FRAGMENT + NAMESAKES) for x in (F.lit(f"person {k}"), F.struct(F.lit(text).alias("name"), F.lit(age).alias("age"))))), F.col("plan"))
    a = c.select("n", "plan", "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("accused") - 1)).alias("j"))
    t["Accused"] = a.select((F.col("n") * 10 + F.col("j")).alias("AccusedMasterID"), F.col("n").alias("CaseMasterID"), F.coalesce(known["name"], name("accused")).alias("AccusedName"), F.coalesce(known["age"], (18 + draw(43, F.col("n"), F.col("j"), "age")).cast("int")).alias("AgeYear"), F.when((draw(10, F.col("n"), F.col("j"), "sex") < 8) | known.isNotNull(), "M").otherwise("F").alias("GenderID"), F.format_string("A%d", F.col("j") + 1).alias("PersonID"))
    person = c.withColumn("j", F.lit(0).cast("long"))
    age = lambda salt: F.when(draw(10_000, F.col("n"), salt) >= NO_AGE * 10_000, (18 + draw(60, F.col("n"), salt + "y")).cast("int"))
    t["Victim"] = person.where(draw(5, F.col("n"), "victim") < 4).select((F.col("n") * 10).alias("VictimMasterID"), F.col("n").alias("CaseMasterID"), name("victim").alias("VictimName"), age("victim").alias("AgeYear"), F.when(draw(2, F.col("n"), "vsex") == 0, "f").otherwise("M").alias("GenderID"), F.lit("0").alias("VictimPolice"))
    t["ComplainantDetails"] = person.select(F.col("n").alias("ComplainantID"), F.col("n").alias("CaseMasterID"), name("complainant").alias("ComplainantName"), age("complainant").alias("AgeYear"), (1 + draw(2, F.col("n"), "o")).alias("OccupationID"), F.lit(1).cast("long").alias("ReligionID"), F.lit(1).cast("long").alias("CasteID"), F.lit("M").alias("GenderID"))
    t["ActSectionAssociation"] = c.select(F.col("n").alias("CaseMasterID"), F.lit(1).cast("long").alias("ActID"), (300 + F.col("kind")).alias("SectionID"), F.lit(1).alias("ActOrderID"), F.lit(1).alias("SectionOrderID"))
    arrested = a.where(draw(10, F.col("n"), F.col("j"), "arrest") < 4)
    area = F.floor(F.col("unit") / 100)
    t["ArrestSurrender"] = arrested.select((F.col("n") * 10 + F.col("j")).alias("ArrestSurrenderID"), F.col("n").alias("CaseMasterID"), F.lit(1).cast("long").alias("ArrestSurrenderTypeID"), F.lit(ANCHOR).cast("date").alias("ArrestSurrenderDate"), F.lit(29).cast("long").alias("ArrestSurrenderStateId"), area.alias("ArrestSurrenderDistrictId"), F.col("unit").alias("PoliceStationID"), F.col("unit").alias("IOID"), area.alias("CourtID"), (F.col("n") * 10 + F.col("j")).alias("AccusedMasterID"), F.lit(True).alias("IsAccused"), F.lit(False).alias("IsComplainantAccused"))
    t["ChargesheetDetails"] = c.where(draw(4, F.col("n"), "sheet") == 0).select(F.col("n").alias("CSID"), F.col("n").alias("CaseMasterID"), start.alias("csdate"), F.lit("A").alias("cstype"), F.col("unit").alias("PolicePersonID"))
    units = [d * 100 + 30 + k for d in DISTRICTS for k in range(3)]
    rows = {
        "State": [(29, "State", 1, True)], "District": [(d, f"District {d}", 29, True) for d in DISTRICTS], "Court": [(d, f"Court {d}", d, 29, True) for d in DISTRICTS],
        "UnitType": [(1, "Police station", "C", 3, True)], "Unit": [(u, f"Station {u}", 1, None, 1, 29, u // 100, True) for u in units], "Rank": [(1, "Inspector", 1, True)], "Designation": [(1, "Officer", True, 1)],
        "Employee": [(u, u // 100, u, 1, 1, f"K{u}", "Officer", None, "M", None, False, None) for u in units], "CrimeHead": [(h, HEADS[h - 3], True) for h in range(3, 9)], "CrimeSubHead": [(h * 10 + k, h, f"Kind {h * 10 + k}", k) for h in range(3, 9) for k in range(1, 6)],
        "Act": [("1", "Penal code", "PC", True)], "Section": [("1", str(300 + h * 10 + k), "", True) for h in range(3, 9) for k in range(1, 6)], "CrimeHeadActSection": [(h, "1", str(300 + h * 10 + k)) for h in range(3, 9) for k in range(1, 6)],
        "CasteMaster": [(1, "-")], "ReligionMaster": [(1, "-")], "OccupationMaster": [(1, "Trade"), (2, "Farming")], "CaseStatusMaster": [(1, "Open"), (2, "Charged"), (3, "Closed")],
        "CaseCategory": [(k, f"Category {k}") for k in range(1, 5)], "GravityOffence": [(1, "Heinous"), (2, "Non heinous")],
    }
    for table, values in rows.items():
        t[table] = spark.createDataFrame(values, SPECS[table].schema)
    return {k: t[k].select(*(F.col(f).cast(kind).alias(f) for f, kind in spec.columns)) for k, spec in SPECS.items()}


def write_planted(spark: SparkSession, folder: str, background: int = 16_000, form: str = "parquet") -> None:
    for name, df in planted_tables(spark, background).items():
        df.write.mode("errorifexists").option("header", True).format(form).save(f"{folder}/{name}.{form}")
