"""Reading generated records out of free text: fenced blocks, record lists, varying field names."""

from pyspark.sql import functions as F

RECORDS = "array<map<string,string>>"
# Fixed value: how a generator marks its answer.
FENCED = r"(?i)```json\s*([\s\S]*?)\s*```"


def extract_fenced_json(c):
    """Trimmed body of the first ```json block, '' without one; the fence may be upper case."""
    return F.regexp_extract(c, FENCED, 1)


def parse_records(c):
    """JSON list to records with lower-case field names; a broken or missing list gives an empty one."""
    records = F.from_json(c, RECORDS, {"mode": "PERMISSIVE"})
    return F.transform(F.coalesce(records, F.array().cast(RECORDS)), coalesce_variants)


def coalesce_variants(record):
    """Field names in lower case; among case variants the first one with a value counts."""
    entries = F.filter(F.map_entries(record), lambda e: e["value"].isNotNull())
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))

    def first_value(name):
        return F.filter(entries, lambda e: F.lower(e["key"]) == name)[0]["value"]

    return F.map_from_arrays(names, F.transform(names, first_value))


def text_list(c):
    """JSON list of strings in a record field; anything else is null."""
    return F.from_json(c, "array<string>")


def was_rejected(raw):
    """True where the text has no fenced block or the block is not a list of records."""
    return F.from_json(F.nullif(extract_fenced_json(raw), F.lit("")), RECORDS).isNull()
