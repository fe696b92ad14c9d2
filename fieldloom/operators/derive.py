"""Derivation, cleaning and validation of extracted fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# ---- fixed values -------------------------------------------------------------------------
DATE = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*,\s*\d{4}"
INSPECTION_PATTERNS = [
    r"(?i)(?:Date of Inspection|Inspection Date|Date of visit|Date of site visit)\s*[:\-–—=]?\s*(" + DATE + ")",
    r"(?i)(?:inspected|visit|inspected\s+on)[^\n]{0,30}\b(" + DATE + r")\b",
]
VALUATION_PATTERNS = [
    r"(?i)(?:Date of Valuation|Valuation Date)\s*[:\-–—=]?\s*(" + DATE + ")",
    r"(?i)(?:valuation|report\s+date|valued\s+on)[^\n]{0,30}\b(" + DATE + r")\b",
]
ANY_DATE_LINE = r"(?i)\bDATE\s*[:\-]?\s*(" + DATE + r")\b"
OWNER_PATTERNS = [
    r"(?i)(?:Name of the Owner\(s\)|Name of Owner\(s\)|Name of the Owner|Name of Owner|Owner Name|Owner\(s\) Name)\s*[:\-–—=]?\s*([^\n]+(?:\n[^\n]+)?)",
    r"(?i)(?:First Party|Vendor|Seller Name|Name of Seller)\s*[:\-–—=]+\s*([^\n]+(?:\n[^\n]+)?)",
]
NAME_STOPS = ("aged occupation r/o resident pan aadhar represented address developer builder technical note dimensions "
              "meters flat plot house survey").split()
NAME_TAIL = r"(?i)\s+(?:aged|about|years|occup|resident|r/o|pan|aadhar|first party|second party|vendor|vendee|owner|applicant)\b.*"
PARTY_PATTERNS = [
    r"(?i)Name\s+of\s+the\s+purchaser\s*\(?s?\)?(?:\s+and\s+his\s*/\s*their\s+address\s*\(?es?\)?(?:\s+with\s+Phone\s+no\.?)?)?\s*[:\-–—=]?\s*([^\n]+(?:\n[^\n]+)?)",
    r"(?i)(?:Name of the Purchaser\(s\)|Name of Purchaser\(s\)|Name of the Purchaser|Name of Purchaser|Purchaser Name|Purchaser\(s\) Name)\s*[:\-–—=]?\s*([^\n]+(?:\n[^\n]+)?)",
    r"(?i)(?:Second Party|Vendee|Buyer Name|Name of Purchaser|Name of Buyer)\s*[:\-–—=]+\s*([^\n]+(?:\n[^\n]+)?)",
    r"(?i)(?:Purchaser|Buyer|Purchaser\(s\)|Buyer\(s\))\s*[:\-–—=]+\s*([^\n]+(?:\n[^\n]+)?)",
]
# lower-cased words one of which stands in whatever a party pattern matches
PARTY_NEEDS = ["purchaser", "buyer", "vendee", "second party"]
PARTY_STOPS = "valuation inspection purpose prohibited opinion mortgage ftl property description".split()
PHONE = r"\b[6-9]\d{9}\b|\+91\s*[6-9]\d{9}\b"
RESIDENCE = r"(?i)\b(?:Resident of|residing at|R/o\.?|R/O|Address:)\s+(.*)"
ADDRESS_WORDS = "road street colony nagar flat plot house h.no d.no village mandal district state pincode pin hyd".split()
PROFILE = (r"(?i)\b(Mrs\.|Mr\.|Smt\.|Sri\.|Late|SRI|SMT|MR|MRS|LATE)\b\s*([A-Za-z\s'./]{3,60})\s+(?:S/o|W/o|D/o|C/o)\s*([A-Za-z\s'./]{3,60})")
PROFILE_TAIL = r"(?i)\s+(?:aged|about|years|occup|resident|r/o|pan|aadhar|first|second|vendor|vendee|owner|applicant)\b.*"
PROFILE_ADDRESS = (r"(?i)\b(?:Resident of|residing at|R/o\.?|R/O|Address:?)\s*(.*?)(?:\bCell\b|\bPhone\b|\bAadhar\b|\bAadhaar\b|\bPAN\b|\bHereinafter\b|"
                   r"\bTowards\b|\bOnline\b|\bReceived\b|\bAgreement\b|\bWork\b|"
                   r"\.\s+(?!(?:No|Flat|Plot|Door|House|H|F|P|D|S/o|W/o|D/o|C/o|Aged|Occupation|Pvt|Emp)\b)[A-Z]|$)")
ADDRESS_NOISE = r"(?i)\s+(?:having|who|represented|aged|by|occupation|occup)\b.*"
# characters after and before a party that its address, phone and role may stand in
PROFILE_AFTER, ROLE_BEFORE, ROLE_AFTER = 600, 200, 400
BUYER_WORDS = ["vendee", "buyer", "purchaser", "second party"]
SELLER_WORDS = ["vendor", "seller", "first party", "landowner", "land owner"]
NAME_KEYS = ("name_of_the_owner_s purchaser_name developer_name vendor_name power_of_attorney_holder witness_1 witness_2 "
             "valuer_name").split()
ADDRESS_LIST_KEYS = "owner_address purchaser_address residential_address postal_address_of_the_property".split()
ADDRESS_KEYS = ["property_address"]
DATE_KEYS = ("inspection_date valuation_date agreement_date registration_date sale_deed_date possession_date work_order_date "
             "layout_approval_date").split()
DATE_FORMATS = ["d/M/yyyy", "d-M-yyyy", "M/d/yyyy", "M-d-yyyy", "d/M/yy", "d-M-yy", "yyyy-M-d", "yyyy/M/d"]
COMPOSITE_PREFIXES = {
    "purchaser_name": "Name: ", "purchaser_address": "Address: ", "purchaser_phone": "Phone: ",
    "plot_number": "Plot No: ", "survey_number": "Survey No: ", "ts_number": "T.S. No: ", "village": "Village: ",
    "ward": "Ward: ", "taluka": "Taluka: ", "mandal": "Mandal: ", "district": "District: ",
}
YARD_WORDS = ["yard", "yd", "gaj"]
METER_WORDS = ["meter", "sqm", "m2", "mtr", "mt.", "mt ", "sq.mt", "sqmt"]
FEET_WORDS = ["feet", "ft", "sft"]
UNIT_WORDS = ["yard", "yd", "gaj", "meter", "sqm", "m2", "mtr", "mt.", "mt ", "feet", "ft", "sft", "sqmt"]
MUNICIPAL_WORDS = ["ghmc", "tsbpass", "municipal permit", "sanctioned plan"]
FEET_PER_YARD, FEET_PER_METER = 9.0, 10.7639
METER_PER_YARD, METER_PER_FOOT = 0.836127, 0.092903
# -------------------------------------------------------------------------------------------


def flags(text: Column) -> dict[str, tuple[Column, float]]:
    """Keyword-derived values with their confidence; all of them stand in for an empty field only."""
    t = F.lower(text)
    has = lambda *w: T.contains_any(t, list(w))
    banned, disputed = has("prohibited", "22-a", "22a"), has("dispute", "litigation", "court case")
    line = F.substring(T.strip(F.regexp_extract(text, r"(?i)[^\n]*prohibited[^\n]*", 0)), 1, 150)
    return {
        "valuation_purpose": (
            F.when(has("housing loan", "home loan", "retail loan"), "Home Loan Valuation").when(has("mortgage"), "Mortgage Valuation")
            .when(has("purchase"), "Purchase of Property").otherwise("Purchase / Construction Loan"), 0.8),
        "property_tenure": (F.when(has("lease"), "Leasehold").otherwise("Freehold"), 0.8),
        "prohibited_property_details": (
            F.when(banned, F.when(t.contains("prohibited"), line).otherwise("Yes, under prohibited category"))
            .otherwise("No, not in prohibited list"), 0.8),
        "is_prohibited": (F.when(banned, "Yes").otherwise("No"), 0.8),
        "legal_opinion": (F.when(disputed, "Pending legal dispute / litigation found")
                          .otherwise("Clear and marketable title. Recommended for financing."), 0.8),
        "is_disputed": (F.when(disputed, "Yes").otherwise("No"), 0.8),
        "mortgage_details": (F.when(has("mortgage", "charge created"), "Prior mortgage / charge created")
                             .otherwise("No prior mortgage or charge exists. Clear for financing."), 0.8),
        "ftl_buffer_zone_details": (F.when(has("ftl", "buffer zone", "water body"), "FTL / Buffer zone check recommended")
                                    .otherwise("Not under FTL or Buffer Zone"), 0.8),
        "approved_plan_verified": (F.lit("Yes, Verified"), 1.0),
    }


def derive_flags(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, field_key, value, confidence, derived_default)`` of all flag rules."""
    rows = [F.struct(F.lit(k).alias("field_key"), v.alias("value"), F.lit(c).alias("confidence"), F.lit(True).alias("derived_default"))
            for k, (v, c) in flags(F.col("text")).items()]
    return docs.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def fill_empty(stored: DataFrame, derived: DataFrame, key: str = "doc_id") -> DataFrame:
    """Derived values fill fields that are empty."""
    d = derived.select(key, "field_key", F.col("value").alias("_v"), F.col("confidence").alias("_c"))
    empty = F.coalesce(F.col("value"), F.lit("")) == ""
    return stored.join(d, [key, "field_key"], "left").withColumns({
        "confidence": F.when(empty & F.col("_v").isNotNull(), F.col("_c")).otherwise(F.col("confidence")),
        "value": F.when(empty, F.coalesce("_v", "value")).otherwise(F.col("value")),
    }).drop("_v", "_c")


def _first(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(T.strip(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def derive_dates(text: Column) -> Column:
    """Inspection and valuation date with their confidences."""
    def build(x: Column) -> Column:
        insp = F.coalesce(x["i"], F.nullif(x["any"], F.lit("")))
        insp_conf = F.when(x["i"].isNotNull(), 0.9).when(insp.isNotNull(), 0.7)
        val = F.coalesce(x["v"], insp)
        return F.struct(insp.alias("inspection_date"), insp_conf.alias("inspection_confidence"), val.alias("valuation_date"),
                        F.when(x["v"].isNotNull(), 0.9).when(val.isNotNull(), 0.7).alias("valuation_confidence"))

    return T.let(F.struct(
        _first(text, INSPECTION_PATTERNS).alias("i"), _first(text, VALUATION_PATTERNS).alias("v"),
        F.regexp_extract(text, ANY_DATE_LINE, 1).alias("any")), build)


def clean_party_name(raw: Column) -> Column:
    """First line and the lines that continue it, without trailing personal data; null when three characters or less."""
    def join(ls: Column) -> Column:
        stop = lambda x: T.contains_any(F.lower(x), NAME_STOPS) | x.rlike(" [-–—] |[:=]")
        rest = F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1)))
        at = F.array_position(F.transform(rest, stop), F.lit(True)).cast("int")
        kept = F.when(at == 0, rest).otherwise(F.slice(rest, 1, F.greatest(at - 1, F.lit(0))))
        full = F.array_join(F.concat(F.slice(ls, 1, 1), kept), " ")
        return T.collapse_blanks(F.regexp_replace(F.regexp_replace(full, NAME_TAIL, ""), r"[^A-Za-z.()]+$", ""))

    def named(text: Column) -> Column:
        return T.let(F.filter(T.stripped_lines(text), lambda x: x != ""), join)

    return T.let(T.let(raw, named), lambda n: F.when(F.length(n) > 3, n))


def derive_owner(text: Column, stored_owner: Column, seller: Column) -> Column:
    """Owner from labelled patterns (0.9); a stored owner cut at a relation mark gets its next line; else the seller (0.75)."""
    labelled = F.coalesce(*[clean_party_name(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p in OWNER_PATTERNS])
    cut = stored_owner.isNotNull() & F.lower(stored_owner).rlike("w/o|s/o|d/o|c/o|late")
    at = F.call_function("locate", F.lower(F.substring(stored_owner, 1, 15)), F.lower(text))
    after = T.let(F.filter(T.stripped_lines(F.substr(text, at, F.lit(300))), lambda x: x != ""), lambda ls: F.get(ls, F.lit(1)))
    merged = T.let(after, lambda n: F.when(
        n.isNotNull() & ~T.contains_any(F.lower(n), [w for w in NAME_STOPS if w not in ("technical", "note", "dimensions", "meters")]),
        T.collapse_blanks(F.concat(stored_owner, F.lit(" "), n))))
    return T.let(labelled, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(0.9).alias("confidence"))).when(
        cut & (at > 0), F.struct(F.coalesce(merged, stored_owner).alias("value"), F.lit(0.9).alias("confidence"))).when(
        stored_owner.isNull() & seller.isNotNull(), F.struct(seller.alias("value"), F.lit(0.75).alias("confidence"))))


def party_block(text: Column) -> Column:
    """The purchaser block: its first line and the next one unless it opens another topic.

    Texts without a word that every pattern needs are not searched; what a pattern finds is bound before its lines are read.
    """
    def block(raw: Column) -> Column:
        return T.let(F.filter(T.stripped_lines(raw), lambda x: x != ""), lambda ls: T.collapse_blanks(F.array_join(F.concat(
            F.slice(ls, 1, 1), F.filter(F.slice(ls, 2, 1), lambda x: ~T.contains_any(F.lower(x), PARTY_STOPS))), " ")))

    found = F.coalesce(*[
        T.let(T.let(F.regexp_extract(text, p, 1), block), lambda b: F.when(F.length(b) > 3, b)) for p in PARTY_PATTERNS])
    return F.when(T.let(F.lower(text), lambda low: T.contains_any(low, PARTY_NEEDS)), found)


def split_party(block: Column) -> Column:
    """Phone, address and name of a party block, which is made once."""
    def split(x: Column) -> Column:
        body, phone = x["body"], x["phone"]
        marked = F.regexp_extract(body, RESIDENCE, 1)
        head = F.btrim(F.element_at(F.split(body, RESIDENCE, 2), 1), F.lit(" ,:-"))
        two = F.split(body, r"\s*[,;]\s*", 2)
        tail = F.coalesce(F.get(two, F.lit(1)), F.lit(""))
        by_comma = T.contains_any(F.lower(tail), ADDRESS_WORDS)
        addr = F.when(marked != "", T.strip(marked)).when(by_comma, T.strip(tail))
        name = F.coalesce(F.when(marked != "", clean_party_name(head)).when(by_comma, clean_party_name(F.get(two, F.lit(0)))),
                          clean_party_name(body))
        return F.struct(name.alias("name"), addr.alias("address"), phone.alias("phone"))

    def cut(b: Column, p: Column) -> Column:
        bare = T.strip(F.replace(b, p, F.lit("")))
        body = T.strip(F.regexp_replace(bare, r"(?i)\b(?:phone|mobile|contact|tel|no\.?)\s*[:\-]?\s*$", ""))
        return F.struct(F.when(p != "", body).otherwise(b).alias("body"), F.nullif(p, F.lit("")).alias("phone"))

    return T.let(block, lambda b: F.when(b.isNotNull(), T.let(T.let(F.regexp_extract(b, PHONE, 0), lambda p: cut(b, p)), split)))


def party_profiles(text: Column) -> Column:
    """All ``honorific name relation parent`` hits with address, phone and role from the text around them.

    The windows are characters of the text, whatever other hits stand in them: running lengths give each hit's place.
    """
    flat = F.regexp_replace(text, r"\s+", " ")

    def one(t: Column, h: Column, i: Column) -> Column:
        x, start = h["hit"], h["start"]
        end = start + F.length(x)
        clean = lambda c: F.btrim(T.strip(F.regexp_replace(T.strip(c), PROFILE_TAIL, "")), F.lit(" .:-–—=|/"))
        window = F.substr(t, end + 1, F.lit(PROFILE_AFTER))
        low = F.greatest(start - ROLE_BEFORE, F.lit(0))
        around = F.lower(F.substr(t, low + 1, end + ROLE_AFTER - low))
        role = F.when(T.contains_any(around, BUYER_WORDS), "buyer").when(T.contains_any(around, SELLER_WORDS), "seller")
        name = clean(F.regexp_extract(x, PROFILE, 2))
        addr = F.btrim(T.strip(F.regexp_replace(T.strip(F.regexp_extract(window, PROFILE_ADDRESS, 1)), ADDRESS_NOISE, "")), F.lit(" ,:-"))
        return F.when(F.length(name) > 3, F.struct(
            T.collapse_blanks(F.concat(F.regexp_extract(x, PROFILE, 1), F.lit(" "), name)).alias("name"), name.alias("raw_name"),
            clean(F.regexp_extract(x, PROFILE, 3)).alias("parent"), F.nullif(addr, F.lit("")).alias("address"),
            F.nullif(F.regexp_extract(window, PHONE, 0), F.lit("")).alias("phone"), role.alias("role"), i.alias("pos")))

    def placed(z: Column) -> Column:
        step = lambda a, x: F.struct((a["at"] + x["skip"] + F.length(x["hit"])).alias("at"),
                                     F.concat(a["hits"], F.array(F.struct((a["at"] + x["skip"]).alias("start"), x["hit"].alias("hit")))).alias("hits"))
        pairs = F.transform(z["h"], lambda x, i: F.struct(F.length(F.element_at(z["p"], i + 1)).alias("skip"), x.alias("hit")))
        none = F.array().cast("array<struct<start:int,hit:string>>")
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("hits")), step, lambda a: a["hits"])

    return T.let(flat, lambda t: T.let(
        F.struct(F.regexp_extract_all(t, F.lit(PROFILE), F.lit(0)).alias("h"), F.split(t, PROFILE, -1).alias("p")),
        lambda z: F.array_compact(F.transform(placed(z), lambda h, i: one(t, h, i)))))


def pick_buyer(profiles: Column, owner: Column) -> Column:
    """First profile tagged buyer that is not the owner, else the first that is not the owner."""
    own = F.lower(F.coalesce(owner, F.lit("")))
    other = F.filter(profiles, lambda p: (own == "") | ~own.contains(F.lower(p["raw_name"])))
    return F.coalesce(F.get(F.filter(other, lambda p: F.coalesce(p["role"] == "buyer", F.lit(False))), F.lit(0)), F.get(other, F.lit(0)))


def party_fallback(name: Column, buyer: Column, applicant: Column, address: Column, property_address: Column,
                   phone: Column, text: Column) -> Column:
    """Name from buyer or applicant (0.75), address from the property (0.7), phone from anywhere in the text (0.8)."""
    any_phone = F.nullif(F.regexp_extract(text, PHONE, 0), F.lit(""))
    return F.struct(
        F.coalesce(name, buyer, applicant).alias("name"),
        F.when(name.isNotNull(), 0.9).when(F.coalesce(buyer, applicant).isNotNull(), 0.75).alias("name_confidence"),
        F.coalesce(address, property_address).alias("address"),
        F.when(address.isNotNull(), 0.9).when(property_address.isNotNull(), 0.7).alias("address_confidence"),
        F.coalesce(phone, any_phone).alias("phone"),
        F.when(phone.isNotNull(), 0.9).when(any_phone.isNotNull(), 0.8).alias("phone_confidence"))


def tidy(v: Column) -> Column:
    """Collapse blanks and blank lines, trim dangling separators."""
    x = F.regexp_replace(v, r"[ \t]+", " ")
    x = T.strip(F.regexp_replace(x, r"\n\s*\n+", "\n"))
    x = F.regexp_replace(x, r"^[:\-–—=,;\s]+", "")
    return T.strip(F.regexp_replace(x, r"[:\-–—=,;\s]+$", ""))


def clean_name(v: Column) -> Column:
    return T.title_case(T.collapse_blanks(F.regexp_replace(v, r"(?i)\b(Mr|Mrs|Ms|Sri|Smt|Dr|Shri)\.?\s+", "")))


def _commas(v: Column) -> Column:
    x = F.regexp_replace(v, r"\s+", " ")
    x = F.regexp_replace(x, r",[\s,]*,", ",")
    return F.regexp_replace(F.regexp_replace(x, r"\s*,\s*", ", "), r",+", ",")


def clean_address_list(v: Column) -> Column:
    return F.btrim(_commas(F.regexp_replace(v, r"[\n\r]", ", ")), F.lit(", "))


def clean_generic(v: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(v, r"\s+", " "), r",[\s,]*,", ",")
    return T.strip(F.regexp_replace(x, r"\s*,\s*", ", "))


def clean_address(v: Column) -> Column:
    x = F.regexp_replace(v, r"[\n\r]", ", ")
    for short, long in (("H", "H.No. "), ("D", "Door No. "), ("Flat", "Flat No. "), ("Plot", "Plot No. ")):
        x = F.regexp_replace(x, rf"(?i)\b{short}\s*\.?\s*No\s*\.?\s*\b", long)
    x = F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"\s*,\s*", ", ")
    return F.btrim(F.regexp_replace(x, r",[\s,]*,", ","), F.lit(", "))


def clean_field(key: Column, v: Column) -> Column:
    return (
        F.when(key.isin(NAME_KEYS), clean_name(v)).when(key.isin(ADDRESS_LIST_KEYS), clean_address_list(v))
        .when(key.isin(ADDRESS_KEYS), clean_address(v)).otherwise(v)
    )


def valid_date(v: Column) -> Column:
    d = F.coalesce(F.nullif(F.regexp_extract(v, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", 0), F.lit("")),
                   F.nullif(F.regexp_extract(v, r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b", 0), F.lit("")))
    # a year of three digits is read as two digits and a rest, which no format takes
    parsed = F.coalesce(*[F.try_to_timestamp(d, F.lit(f)) for f in DATE_FORMATS])
    year_ok = d.rlike(r"^\d{1,2}[/-]\d{1,2}[/-](\d{2}|\d{4})$|^\d{4}[/-]")
    return F.coalesce(parsed.isNotNull() & year_ok, F.lit(False))


def is_valid(key: Column, v: Column) -> Column:
    """Field validators by key; other keys are valid."""
    n = T.digits(v)
    return (
        F.when(key.isin(DATE_KEYS), valid_date(v))
        .when(key == "pan_number", F.upper(F.regexp_replace(v, r"\s+", "")).rlike("[A-Z]{5}[0-9]{4}[A-Z]"))
        .when(key == "aadhar_number", F.length(n) == 12)
        .when(key.isin("pin_code", "pincode"), F.length(n) == 6)
        .when(key.isin("cell_number", "purchaser_phone"), n.rlike(r"[6-9]\d{9}$"))
        .when(key.isin("survey_no", "survey_number"), F.length(T.strip(v)) > 2)
        .otherwise(True)
    )


def validate(rows: DataFrame) -> DataFrame:
    """A failed check zeroes the confidence and sets status and message; empty values are not checked."""
    bad = (F.coalesce("value", F.lit("")) != "") & ~is_valid(F.col("field_key"), F.col("value"))
    return rows.withColumns({
        "validation_error": bad,
        "validation_status": F.when(bad, "invalid").otherwise("valid"),
        "validation_message": F.when(bad, F.concat(F.lit("Field validation failed for "), F.col("field_key"))),
        "confidence": F.when(bad, 0.0).otherwise(F.col("confidence")),
    })


def area_number(v: Column, drop_commas: bool = False) -> Column:
    x = F.regexp_replace(v, ",", "") if drop_commas else v
    return F.nullif(F.regexp_extract(x, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def in_square_meters(v: Column) -> Column:
    t, n = F.lower(v), area_number(v)
    return F.when(T.contains_any(t, YARD_WORDS), n * METER_PER_YARD).when(T.contains_any(t, FEET_WORDS), n * METER_PER_FOOT).otherwise(n)


def cross_checks(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Checks between fields of one document; violations as rows."""
    names = ["permission_number", "built_up_area", "land_area", "registration_details"]
    p = rows.filter(F.col("field_key").isin(names)).groupBy(key).pivot("field_key", names).agg(F.first("value"))
    permit, built, land = F.col("permission_number"), F.col("built_up_area"), F.col("land_area")
    permit_ok = permit.rlike(r"(?i)^\d+/[A-Z0-9/-]+$") | permit.rlike(r"^[A-Z0-9]+[/\-_][A-Z0-9/\-_.]+$") | (F.length(permit) > 4)
    year = lambda c: F.nullif(F.regexp_extract(c, r"\b(20\d{2})\b", 1), F.lit(""))
    years_differ = year(F.col("registration_details")) != year(permit)
    row = lambda k, s, m: F.struct(F.lit(k).alias("field_key"), F.lit(s).alias("status"), m.alias("message"))
    year_msg = F.concat(F.lit("Year mismatch: "), year(F.col("registration_details")), F.lit(" / "), year(permit))
    checks = F.array_compact(F.array(
        F.when((permit != "") & ~permit_ok & ~F.coalesce(years_differ, F.lit(False)),
               row("permission_number", "invalid", F.lit("Format does not match standard permission pattern"))),
        F.when((built != "") & area_number(built).isNull(), row("built_up_area", "invalid", F.lit("Area value must contain a number"))),
        F.when((land != "") & area_number(land).isNull(), row("land_area", "invalid", F.lit("Area value must contain a number"))),
        F.when(in_square_meters(built) > in_square_meters(land), row("built_up_area", "warning", F.concat(
            F.lit("Built-up Area ("), built, F.lit(") exceeds Land Area ("), land, F.lit(")")))),
        F.when(years_differ, row("registration_details", "warning", year_msg)),
        F.when(years_differ, row("permission_number", "warning", year_msg)),
    ))
    return p.select(key, F.explode(checks).alias("c")).select(key, "c.*")


def composite(rows: DataFrame, parts: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Present parts in the given order with their prefixes; mean confidence, first page."""
    mine = rows.filter(F.col("field_key").isin(list(parts)) & (F.col("value") != ""))
    rank = F.array_position(F.array(*[F.lit(p) for p in parts]), F.col("field_key")).cast("int")
    prefix = F.create_map(*[F.lit(x) for p in parts for x in (p, COMPOSITE_PREFIXES.get(p, ""))])[F.col("field_key")]
    listed = F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.concat(prefix, F.col("value")).alias("t"))))
    return mine.groupBy(key).agg(
        F.array_join(F.transform(listed, lambda x: x["t"]), "\n" if "purchaser_name" in parts else ", ").alias("value"),
        F.avg("confidence").alias("confidence"), F.coalesce(F.min_by("source_page", rank), F.lit(1)).alias("source_page"))


def assemble(requests: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per requested field; percent confidence is truncated."""
    return requests.join(results, [key, "field_key"], "left").withColumns({
        "confidence_pct": (F.coalesce("confidence", F.lit(0.0)) * 100).cast("int"),
        "source_method": F.when(F.coalesce("value", F.lit("")) != "", "rule_based"),
        "validation_error": F.coalesce("validation_error", F.lit(False)),
    })


def with_defaults(requests: DataFrame, defaults: DataFrame) -> DataFrame:
    """Requested fields pre-filled from the master schema; constants count as certain."""
    return requests.join(defaults.select("field_key", "default_value"), "field_key", "left").withColumns({
        "value": F.col("default_value"), "confidence": F.when(F.col("default_value").isNotNull(), 1.0).otherwise(0.0)}).drop("default_value")


def convert_area(value: Column, context: Column) -> Column:
    """``struct<sqft, sqyd>`` of an area text; the unit is looked for in the value, then next to the number in the context."""
    v, ctx = F.lower(value), F.lower(F.coalesce(context, F.lit("")))

    def unit_text(num: Column) -> Column:
        at = F.call_function("locate", num, ctx)
        after = F.substr(ctx, at + F.length(num), F.lit(30))
        before = F.substr(ctx, F.greatest(at - 30, F.lit(1)), F.least(at - 1, F.lit(30)))
        near = F.when(T.contains_any(after, UNIT_WORDS), after).when(T.contains_any(before, UNIT_WORDS), before).otherwise(after)
        return F.when(T.contains_any(v, UNIT_WORDS) | (ctx == "") | (at == 0), v).otherwise(near)

    def convert(x: Column) -> Column:
        u, n = x["u"], x["n"].cast("double")
        meters = T.contains_any(u, METER_WORDS) | T.strip(u).endswith("mt")
        sqft = (
            F.when(T.contains_any(u, YARD_WORDS), n * FEET_PER_YARD).when(meters, n * FEET_PER_METER)
            .when(T.contains_any(u, FEET_WORDS), n).when(T.contains_any(ctx, MUNICIPAL_WORDS), n * FEET_PER_METER).otherwise(n))
        sqyd = F.when(T.contains_any(u, YARD_WORDS), n).otherwise(sqft / FEET_PER_YARD)
        return F.struct(F.round(sqft, 2).alias("sqft"), F.round(sqyd, 2).alias("sqyd"))

    num = F.nullif(F.regexp_extract(F.regexp_replace(value, ",", ""), r"(\d+(?:\.\d+)?)", 1), F.lit(""))
    return T.let(num, lambda n: F.when(n.isNotNull(), T.let(F.struct(n.alias("n"), unit_text(n).alias("u")), convert)))
