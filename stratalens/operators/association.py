"""Association search: a seed case with its own entities, and one entity expanded into the
cases it shares, filtered and paged.

Frames have roles: ``cases`` (case_id, station_id, district_id, subhead_id,
registered_date), ``people`` (role accused or victim, record_id, case_id, name, age,
gender) and ``identities`` (id of an accused record, cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# What a channel's edges say: relation, classification, weight.
CHANNELS = {
    "same_suspect": ("SAME_IDENTITY", "POTENTIAL_ASSOCIATION", 1.0),
    "same_victim": ("SAME_IDENTITY", "POTENTIAL_ASSOCIATION", 1.0),
    "same_station": ("REGISTERED_AT", "FACT", 0.4),
    "same_subhead": ("CLASSIFIED_AS", "FACT", 0.35),
    "same_district": ("OCCURRED_IN", "FACT", 0.2),
}
# Channel, and the column shared, of each kind of entity.
CHANNEL_OF = {
    "ACCUSED_RECORD": ("same_suspect", None),
    "VICTIM_RECORD": ("same_victim", None),
    "POLICE_STATION": ("same_station", "station_id"),
    "DISTRICT": ("same_district", "district_id"),
    "CRIME_SUBHEAD": ("same_subhead", "subhead_id"),
}


def _ref(kind: str, column) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(column) if isinstance(column, str) else column).cast("string"))


def _edges(df: DataFrame, rel: str, classification: str, src, dst, weight: float) -> DataFrame:
    out = df.select(F.lit(rel).alias("rel"), F.lit(classification).alias("classification"), src.alias("src"), dst.alias("dst"), F.lit(weight).alias("weight"), F.col("case_id").cast("long").alias("case_id"))
    return out.where("src is not null and dst is not null").withColumn("edge_id", F.concat_ws("|", "rel", "src", "dst"))


def seed_edges(cases: DataFrame, people: DataFrame, case_id: int) -> DataFrame:
    """The overview: facts of the seed case; the other end of each edge can be expanded."""
    seed, own = cases.where(F.col("case_id") == case_id), people.where(F.col("case_id") == case_id)
    case = _ref("CASE", "case_id")
    parts = [_edges(seed, CHANNELS[channel][0], "FACT", case, _ref(kind, column), 1.0) for kind, (channel, column) in CHANNEL_OF.items() if column]
    for role, kind, rel in (("accused", "ACCUSED_RECORD", "ACCUSED_IN"), ("victim", "VICTIM_RECORD", "VICTIM_IN")):
        parts.append(_edges(own.where(F.col("role") == role), rel, "FACT", _ref(kind, "record_id"), case, 1.0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def passing(cases: DataFrame, people: DataFrame, *, station_id=None, district_id=None, subhead_id=None, date_from=None, date_to=None, name_exact=None, name_contains=None, gender=None, age_min=None, age_max=None) -> DataFrame:
    """Cases for which all given filters hold. Names are those of any person, gender and
    age those of an accused; each is a semi-join on the case."""
    out = cases
    for column, value in (("station_id", station_id), ("district_id", district_id), ("subhead_id", subhead_id)):
        if value:
            out = out.where(F.col(column).cast("string") == str(value))
    if date_from:
        out = out.where(F.col("registered_date") >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.where(F.col("registered_date") <= F.lit(date_to).cast("date"))
    accused, wanted = people.where("role = 'accused'"), []
    if name_exact:
        wanted.append(people.where(F.lower(F.trim("name")) == name_exact.strip().lower()))
    if name_contains:
        wanted.append(people.where(F.contains(F.lower("name"), F.lit(name_contains.lower()))))
    if gender:
        wanted.append(accused.where(F.col("gender") == gender))
    if age_min is not None or age_max is not None:
        wanted.append(accused.where(F.col("age").between(0 if age_min is None else age_min, 200 if age_max is None else age_max)))
    for w in wanted:
        out = out.join(w.select(F.col("case_id").alias("_case")), F.col("case_id") == F.col("_case"), "left_semi")
    return out


def related_cases(cases: DataFrame, people: DataFrame, identities: DataFrame, case_id: int, focus: str, **filters) -> DataFrame:
    """``case_id, member``: other cases that share the focus entity; member is the smallest
    record of it in the case, null for places. An entity that the seed lacks gives none."""
    kind, _, ref = focus.partition(":")
    if kind not in CHANNEL_OF:
        return cases.where("false").select("case_id", F.lit(None).cast("long").alias("member"))
    channel, column = CHANNEL_OF[kind]
    other = passing(cases, people, **filters).where(F.col("case_id") != case_id)
    if column:
        shared = cases.where(F.col("case_id") == case_id).select(F.col(column).alias("_shared")).distinct()
        return other.join(shared, F.col(column) == F.col("_shared"), "left_semi").select("case_id", F.lit(None).cast("long").alias("member"))
    if channel == "same_suspect":
        cluster = identities.where(F.col("id").cast("string") == ref).select(F.col("cluster").alias("_c"))
        same = identities.join(cluster, F.col("cluster") == F.col("_c"), "left_semi").select(F.col("id").alias("_id"))
        records = people.where("role = 'accused'").join(same, F.col("record_id") == F.col("_id"), "left_semi")
    else:
        victims = people.where("role = 'victim'").withColumn("_name", F.lower(F.trim("name")))
        name = victims.where((F.col("case_id") == case_id) & (F.col("record_id").cast("string") == ref) & (F.col("_name") != "")).select(F.col("_name").alias("_n"))
        records = victims.join(name, F.col("_name") == F.col("_n"), "left_semi")
    first = records.groupBy(F.col("case_id").alias("_case")).agg(F.min("record_id").alias("member"))
    return other.join(first, F.col("case_id") == F.col("_case")).select("case_id", "member")


def expanded_edges(cases: DataFrame, people: DataFrame, identities: DataFrame, case_id: int, focus: str, limit: int = 40, offset: int = 0, **filters) -> DataFrame:
    """A page of the focus entity's related cases as edges, on top of the seed's own."""
    own = seed_edges(cases, people, case_id)
    kind = focus.partition(":")[0]
    if kind not in CHANNEL_OF:
        return own
    channel, column = CHANNEL_OF[kind]
    rel, classification, weight = CHANNELS[channel]
    page = related_cases(cases, people, identities, case_id, focus, **filters).orderBy("case_id").offset(offset).limit(limit)
    at = F.lit(focus)
    if column:
        more = _edges(page, rel, classification, _ref("CASE", "case_id"), at, weight)
    else:
        fact = "ACCUSED_IN" if channel == "same_suspect" else "VICTIM_IN"
        more = _edges(page, fact, "FACT", _ref(kind, "member"), _ref("CASE", "case_id"), 1.0).unionByName(_edges(page, rel, classification, at, _ref(kind, "member"), weight))
    return own.unionByName(more).dropDuplicates(["edge_id"])
