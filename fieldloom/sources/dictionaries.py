"""Dictionaries: display names, the master field list with its defaults, and label aliases.

The built-in aliases are a short core list plus rules over the field keys. A full alias dictionary is an input:
pass a table ``(dict_rank, field_key, key_rank, alias, alias_rank)`` to :func:`aliases`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values -------------------------------------------------------------------------
DISPLAY_NAMES = {
    "Borrower Name": "owner_name",
    "Owner Name": "owner_name",
    "Name of Owner": "owner_name",
    "Name of Owner(s)": "owner_name",
    "Name of Owner(S)": "owner_name",
    "Survey Number": "survey_number",
    "Survey No": "survey_number",
    "Survey No. / Door No.": "survey_number",
    "Village": "village",
    "Door Number": "door_number",
    "Property Address": "property_address",
    "Property Description": "property_description",
    "Date of Inspection": "inspection_date",
    "Date of Valuation": "valuation_date",
    "Purchaser Details": "purchaser_name",
    "Purchaser Name": "purchaser_name",
    "Application / LAN No.": "document_id",
    "Purpose": "valuation_purpose",
    "Date of Visit": "inspection_date",
    "Date of Report": "valuation_date",
}

MASTER_FIELDS = """
valuation_purpose inspection_date valuation_date
document_type document_id source_pages ocr_confidence overall_confidence extraction_timestamp
aos_buyer_name aos_seller_name aos_sale_deed_doc_number aos_property_schedule permission_number wo_party_name
rera_registration_number document_number registration_details
owner_name purchaser_name purchaser_address purchaser_phone ownership_type applicant_name
property_description property_tenure built_up_area land_area
prohibited_property_details prohibited_transaction is_prohibited
legal_opinion legal_disputes is_disputed
mortgage_details ftl_buffer_zone_details market_value guideline_value
plot_number survey_number door_number ts_number village ward taluka mandal district layout_approval_date
layout_approval_validity approved_plan_authority approved_plan_verified approved_plan_comments
property_address
city is_residential_area is_commercial_area is_industrial_area super_built_up_area carpet_area
area_class area_type property_classification zone_type
municipality_type municipality_name local_body_type
under_govt_enactment enactment_details govt_enactment_details is_govt_land
boundary_north_deed boundary_south_deed boundary_east_deed boundary_west_deed
boundary_north_actual boundary_south_actual boundary_east_actual boundary_west_actual
boundary_north boundary_south boundary_east boundary_west
state pincode land_area_sqyd built_up_area_sqft project_name registration_number registration_date agreement_value
""".split()

MASTER_DEFAULTS = {
    "approved_plan_verified": "Yes, Verified",
    "approved_plan_comments": "Title flow to be Verified with the legal opinion.",
    "city": "City",
    "is_residential_area": "Residential Area",
    "is_commercial_area": "No",
    "is_industrial_area": "No",
    "area_class": "Middle",
    "area_type": "Urban",
    "boundary_north_deed": "OPEN TO SKY",
    "boundary_south_deed": "OPEN TO SKY",
    "boundary_east_deed": "CORRIDOR & LIFT AND FLAT NO. 302",
    "boundary_west_deed": "OPEN TO SKY",
    "boundary_north_actual": "OPEN TO SKY",
    "boundary_south_actual": "OPEN TO SKY",
    "boundary_east_actual": "CORRIDOR & LIFT AND FLAT NO. 302",
    "boundary_west_actual": "OPEN TO SKY",
}

# the core aliases; the rules below and the caller's table add to them
CORE_ALIASES = {
    "name_of_the_owner_s": ["Name of Owner", "Name of the Owner", "Owner Name", "Land Owner"],
    "purchaser_name": ["Name of Purchaser", "Name of the Purchaser", "Purchaser Name", "Buyer Name", "Vendee"],
    "vendor_name": ["Vendor Name", "Name of Vendor", "Seller Name", "Vendor"],
    "pan_number": ["PAN No", "PAN Number", "PAN Card No", "PAN"],
    "aadhar_number": ["Aadhar No", "Aadhaar No", "Aadhar Number", "Aadhaar Number"],
    "survey_number": ["Survey Number", "Survey No", "Sy No", "Sy. No."],
    "plot_number": ["Plot Number", "Plot No"],
    "door_number": ["Door Number", "Door No", "House No", "Flat No"],
    "village": ["Village", "Village Name"],
    "mandal": ["Mandal", "Tahsil"],
    "district": ["District", "Dist."],
    "pincode": ["Pincode", "Pin Code", "Postal Code"],
    "inspection_date": ["Inspection Date", "Date of Inspection", "Date of Visit"],
    "valuation_date": ["Valuation Date", "Date of Valuation"],
    "land_area": ["Land Area", "Extent of Land", "Plot Area"],
    "built_up_area": ["Built-up Area", "Built Up Area", "Builtup Area"],
    "permission_number": ["Permission Number", "Permit No", "File No"],
    "property_description": ["Property Description", "Description of Property"],
    "property_address": ["Property Address", "Site Address"],
    "boundary_north": ["North", "North Boundary"],
    "boundary_south": ["South", "South Boundary"],
    "boundary_east": ["East", "East Boundary"],
    "boundary_west": ["West", "West Boundary"],
}
# -------------------------------------------------------------------------------------------

ALIAS_SCHEMA = "dict_rank int, field_key string, key_rank int, alias string, alias_rank int"


def words_of(key: str) -> str:
    return key.replace("_", " ").title()


def rule_aliases(key: str) -> list[str]:
    """Spellings that follow from the key itself: its words, Number as No, and the reversed form of a Name or Date."""
    title = words_of(key)
    out = [title]
    head, _, last = title.rpartition(" ")
    if head and last == "Number":
        out += [f"{head} No", f"{head} No."]
    if head and last == "Name":
        out += [f"Name of {head}", f"Name of the {head}"]
    if head and last == "Date":
        out += [f"Date of {head}"]
    return out


def builtin_alias_rows() -> list[tuple[int, str, int, str, int]]:
    """Dictionary 0 is the core list, dictionary 1 the rules over the master fields; keys and aliases keep their order."""
    rows = []
    for k, (key, names) in enumerate(CORE_ALIASES.items()):
        rows += [(0, key, k, a, i) for i, a in enumerate(names)]
    for k, key in enumerate(MASTER_FIELDS):
        rows += [(1, key, k, a, i) for i, a in enumerate(rule_aliases(key))]
    return rows


def aliases(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The alias dimension: the built-in rows, or the caller's table."""
    if path:
        return spark.read.schema(ALIAS_SCHEMA).parquet(path)
    return spark.createDataFrame(builtin_alias_rows(), ALIAS_SCHEMA)


def display_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, k, i) for i, (n, k) in enumerate(DISPLAY_NAMES.items())], "name string, field_key string, name_rank int")


def master_defaults(spark: SparkSession, keep_constants: bool = True) -> DataFrame:
    """The master fields; their constant values can be left out."""
    return spark.createDataFrame(
        [(k, i, MASTER_DEFAULTS.get(k) if keep_constants else None) for i, k in enumerate(MASTER_FIELDS)],
        "field_key string, field_rank int, default_value string")
