"""Schemas of the registry's tables. Codes are text; unknown is null, never ''."""

from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType, TimestampType

_KINDS = {"i": IntegerType(), "s": StringType(), "b": BooleanType(), "t": TimestampType()}


def _table(**columns: str) -> StructType:
    return StructType([StructField(name, _KINDS[kind]) for name, kind in columns.items()])


STATES = _table(state_id="i", state_code="s", state_name_en="s", state_name_hi="s", source="s", source_version="s")
DISTRICTS = _table(district_id="i", district_name_en="s", district_name_hi="s", mandala_id="i", state_id="i", lgd_district_code="s", source="s", source_version="s")
CONSTITUENCIES = _table(id="i", constituency="s", district="s", constituency_hindi="s", district_id="i", state_id="i", ac_number="i", lgd_district_code="s", source="s", source_version="s", mapping_confidence="s")
VOTERS = _table(
    id="s", user_id="s", name="s", epic="s", mobile="s", address="s", serial_number="i", part_number_and_name="s", assembly_constituency_id="i", assembly_constituency_name="s", district="s", state="s", mandal_id="i", district_id="i", booth_id="i"
)
BOOTHS = _table(id="i", booth_name="s", constituency_id="i", district_id="i", mandal_id="i", created_at="t")
USERS = _table(id="s", first_name="s", last_name="s", username="s", email="s", mobile="s", hashed_password="s", role="s", mandal_id="i", district_id="i", constituency_id="i", booth_id="i", is_active="b", created_at="t")
JOBS = _table(id="s", user_id="s", image_path="s", is_cropped="b", status="s", result="s", error_message="s", created_at="t")
REQUESTS = _table(req_id="i", name="s", state_code="s", state_name="s", district_lgd_code="s", district_name="s", ac_number="i", constituency_id="i")
ALIASES = _table(kind="s", state_code="s", ac_number="s", alias="s", canonical="s", relation="s", source="s", evidence="s")
