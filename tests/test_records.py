import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.errors import EngineError
from ledgerlark.operators import records as R
from ledgerlark.schemas import VOTERS


@pytest.fixture(scope="module")
def voters(spark):
    base = dict.fromkeys(VOTERS.fieldNames())
    rows = [
        base | {"id": "1", "user_id": "u1", "name": "Asha", "epic": "A1", "mobile": "98", "district_id": 1, "mandal_id": 1, "assembly_constituency_id": 5, "booth_id": 0},
        base | {"id": "2", "user_id": "u2", "name": "50% off", "epic": None, "district_id": 2, "mandal_id": 1, "assembly_constituency_id": 5},
        base | {"id": "3", "user_id": "u1", "name": "a_b", "epic": None, "district_id": 1, "mandal_id": 2, "assembly_constituency_id": 6},
        base | {"id": "4", "user_id": None, "name": None, "epic": "A1", "district_id": 0, "mandal_id": None, "assembly_constituency_id": 7},
        base | {"id": "5", "user_id": "u3", "name": "", "epic": "B\\2", "district_id": 1, "mandal_id": 1, "assembly_constituency_id": 5},
    ]
    return spark.createDataFrame([tuple(r.values()) for r in rows], VOTERS)


def ids(df):
    return [r["id"] for r in df.select("id").collect()]


@pytest.mark.parametrize(("role", "owner", "want"), [("booth", "u1", {"1", "3"}), ("constituency", 5, {"1", "2", "5"}), ("district", 1, {"1", "3", "5"}), ("mandal", 1, {"1", "2", "5"}), ("superadmin", None, {"1", "2", "3", "4", "5"}), ("booth", None, set())])
def test_roles(voters, role, owner, want):
    assert set(ids(R.role_scope(voters, role, owner))) == want


def test_unknown_role(voters):
    with pytest.raises(EngineError) as e:
        R.role_scope(voters, "guest", 1)
    assert e.value.code == "INVALID_ROLE"


@pytest.mark.parametrize(("filters", "want"), [({"name": "%"}, {"1", "2", "3", "5"}), ({"name": " "}, {"1", "2", "3", "5"}), ({"name": ""}, {"1", "2", "3", "4", "5"}), ({"name": "ASH"}, {"1"}), ({"name": r"50\%"}, {"2"}), ({"epic": r"b\\2"}, {"5"}), ({"district_id": 0}, {"4"}), ({"search": "98"}, {"1"}), ({"booth_id": 0}, {"1"})])
def test_filters(voters, filters, want):
    assert set(ids(R.apply_filters(voters, R.Filters(**filters)))) == want


def test_applied_keeps_zero():
    assert R.Filters(name="", district_id=0).applied() == {"district_id": 0}


def test_null_order_and_pages(voters):
    assert ids(voters.orderBy(*R.ordering("epic", "asc"))) == ["1", "4", "5", "2", "3"]
    assert ids(voters.orderBy(*R.ordering("epic", "DESC"))) == ["2", "3", "5", "1", "4"]
    order = R.ordering("epic", "asc")
    assert sum((ids(R.page(voters, n, 2, order)) for n in (1, 2, 3)), []) == ids(voters.orderBy(*order))


@pytest.mark.parametrize(("args", "code"), [(("mobile", "asc"), "INVALID_SORT_FIELD"), (("name", "up"), "INVALID_SORT_ORDER")])
def test_bad_order(args, code):
    with pytest.raises(EngineError) as e:
        R.ordering(*args)
    assert e.value.code == code


def test_bad_pages(voters):
    for number, size in ((0, 50), (1, 201), (1, 0)):
        with pytest.raises(EngineError):
            R.page(voters, number, size, R.ordering("name", "asc"))


def test_meta_of_nothing(voters):
    assert tuple(R.page_meta(voters.where("false"), 1, 50).first()) == (0, 0, 1, True)


def test_export_header(voters):
    assert R.export(voters).columns == ["ID", "Name", "EPIC", "Mobile", "Address", "Serial Number", "Part", "Constituency", "District", "State"]


@given(st.text(alphabet="ab%_\\ ", max_size=6))
def test_pattern_is_a_valid_like(value):
    pattern = R.like_pattern(value)
    rest = pattern[1:-1]
    i = 0
    while i < len(rest):
        if rest[i] == "\\":
            assert rest[i + 1 : i + 2] in ("%", "_", "\\")
            i += 1
        i += 1


def test_scope_is_in_the_plan(voters):
    plan = R.apply_filters(R.role_scope(voters, "district", 1), R.Filters(name="a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "district_id" in plan


def test_serialise_keeps_null(voters):
    assert R.serialise(voters).where(F.col("id") == "4").first()["user_id"] is None
