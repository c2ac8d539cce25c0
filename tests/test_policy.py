from __future__ import annotations

import json

import pytest

from varve.functions.masking import mask_email
from varve.operators import policy
from varve.operators.policy import BadRule, Refused

SUBJECT, TABLE = {"tenant": "t1"}, {"tenantColumn": "team"}


def rule(kind, name, **parameters):
    return {"kind": kind, "name": name, "parameters": parameters}


def mask(*columns):
    return rule("column_mask", "mask_email", columns=list(columns))


TENANT = rule("row_filter", "tenant_isolation", principal_attribute="tenant", resource_attribute="tenantColumn")


def view(df, *rules, subject=SUBJECT, table=TABLE):
    return policy.apply_rules(rules, subject, table).view(df)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "alice@example.com", "t1"), (2, None, "t2"), (3, "invalid", "t1")],
        "id BIGINT, email STRING, team STRING",
    )


@pytest.mark.parametrize("email, masked", [
    (None, None), ("alice@example.com", "a***@example.com"), ("a@example.com", "a***@example.com"),
    ("not-an-email", "***"), ("@example.com", "***"), ("a@", "***"), ("a@b@c", "a***@b@c"),
    ("", "***"), ("@", "***"), ("é@x", "é***@x"), ("@@", "***"), (" @x", " ***@x"),
])
def test_mask_email(spark, email, masked):
    df = spark.createDataFrame([(email,)], "e STRING")
    assert df.select(mask_email(df.e)).first()[0] == masked


def test_projection_keeps_order_and_other_columns(people):
    out = view(people, mask("email"))
    assert out.columns == people.columns
    assert [r.email for r in out.orderBy("id").collect()] == ["a***@example.com", None, "***"]
    assert view(people) is people


def test_filter_runs_before_masks_and_columns(people):
    out = view(people, mask("team"), TENANT, rule("column_allow", "ids", columns=["team", "id"]))
    assert sorted(map(tuple, out.collect())) == [(1, "***"), (3, "***")]
    assert out.columns == ["id", "team"]


@pytest.mark.parametrize("bad, reason", [
    (mask("phone"), "no column phone to mask"),
    (rule("column_mask", "rot13", columns=["email"]), "not supported"),
    (rule("row_filter", "recent_only"), "not supported"),
    (rule("drop_table", "mask_email"), "not supported"),
    (rule("column_allow", "x", columns=["phone"]), "no column phone to show"),
])
def test_fails_closed(people, bad, reason):
    with pytest.raises(Refused, match=reason):
        view(people, bad)


def test_conflicting_masks_and_disjoint_columns(people, monkeypatch):
    monkeypatch.setitem(policy.MASKS, "other", mask_email)
    monkeypatch.setitem(policy.RULES, ("column_mask", "other"), policy._mask)
    with pytest.raises(Refused, match="more than one mask"):
        view(people, mask("email"), rule("column_mask", "other", columns=["email"]))
    assert view(people, mask("email"), mask("email", "team")).columns == people.columns
    with pytest.raises(Refused, match="no column"):
        view(people, rule("column_allow", "a", columns=["id"]), rule("column_allow", "b", columns=["team"]))


@pytest.mark.parametrize("columns", [None, [], "email", [1]])
def test_bad_parameters(people, columns):
    with pytest.raises(BadRule):
        view(people, rule("column_mask", "mask_email", columns=columns))


@pytest.mark.parametrize("who, what", [({}, TABLE), (SUBJECT, {}), (SUBJECT, {"tenantColumn": "gone"})])
def test_tenant_filter_needs_both_attributes(people, who, what):
    with pytest.raises(Refused):
        view(people, TENANT, subject=who, table=what)


def answer(*policies, allow=True, errors=()):
    return policy.access({"allow": allow, "policies": policies, "errors": errors}, policy.DEFAULT_RULES, SUBJECT, TABLE)


def test_access():
    made = answer("tenant-reader", "pii-reader", "pii-reader")
    assert made.values == {"team": ["t1"]} and made.masks == {"email": {"mask_email"}} and not made.visible
    assert answer("public-reader") == policy.Access()
    for refused in ({"allow": False}, {"errors": ("boom",)}, {"policies": ("unheard-of",)}):
        with pytest.raises(Refused):
            policy.access({"allow": True, "policies": ("pii-reader",), **refused}, policy.DEFAULT_RULES, SUBJECT, TABLE)


def test_rule_file(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(policy.DEFAULT_RULES))
    assert policy.load_rules(str(path)) == policy.DEFAULT_RULES
