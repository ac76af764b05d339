import json
import random

import pytest

from veilwright import compile_rule, decode, parse_legacy, policy_hash, validate
from veilwright.errors import PolicyError
from veilwright.plans.policy import MAX_PAGE_SIZE, MAX_POLICY_BYTES, canonical_json, findings, page_size
from veilwright.plans.rules import LEGACY_NAMES, PARAMS, STRATEGIES, UNKEYED

# The least that a strategy's rule has to say.
NEEDED = {"alphanumeric": {"length": 9}, "digits": {"length": 9}, "constant": {"value": "v"}}
RULE = {"name": "note", "strategy": "text"}


def doc(tables=None, **more):
    """A policy over one database; `database` replaces fields of its entry."""
    entry = {"name": "shop", "tables": [{"name": "visits", "columns": [RULE]}] if tables is None else tables}
    entry |= more.pop("database", {})
    return {"databases": [{k: v for k, v in entry.items() if v is not None}], **more}


def shuffled(value, rng):
    if isinstance(value, dict):
        keys = list(value)
        rng.shuffle(keys)
        return {k: shuffled(value[k], rng) for k in keys}
    return [shuffled(v, rng) for v in value] if isinstance(value, list) else value


def full():
    source = {"name": "files", "key": "tidy"}
    return doc(
        tables=[
            {"name": "visits", "primaryKey": ["day", "no"], "pageSize": 12, "ignore": {"where": "no < 0"}, "columns": [
                {"name": "guest", "strategy": "fullName", "consistent": False, "onNull": "Generate"},
                {"name": "code", "strategy": "digits", "params": {"length": 6}, "onEmpty": "Keep"}]},
            {"name": "drafts", "action": "Truncate", "optional": True}],
        determinism={"mode": "Fixed", "seedSecretRef": {"name": "seed", "key": "bytes"}},
        defaults={"emailDomain": "mail.example", "pageSize": 300}, steps=[{"name": "tidy", "configMapKeyRef": source}],
        database={"pre": [{"name": "tidy"}]},
    )


def test_hash_does_not_depend_on_the_order_of_keys():
    rng = random.Random(11)
    assert {decode(json.dumps(shuffled(full(), rng)))[1] for _ in range(8)} == {policy_hash(full())}


def test_hash_of_a_known_document():
    # Pinned: pseudonyms depend on it, so it must never change.
    assert canonical_json(doc()) == (
        '{"determinism":{},"databases":[{"name":"shop","tables":[{"name":"visits","columns":[{"name":"note","strategy":"text"}]}]}]}')
    assert policy_hash(doc()) == "sha256:35ee29e438cc814d5e93d1576af857677365cc24c9ecd6e1a7f169b27f4a0b52"


def test_zero_values_are_left_out_where_they_say_nothing():
    spec = doc(tables=[{"name": "t", "optional": False, "columns": [
        {"name": "a&b", "strategy": "constant", "params": {"value": "", "unique": False, "maskChar": ""}, "onEmpty": ""}]}],
        defaults={"locale": "", "pageSize": 0})
    assert json.loads(canonical_json(spec)) == {"determinism": {}, "defaults": {}, "databases": [{"name": "shop", "tables": [
        {"name": "t", "columns": [{"name": "a&b", "strategy": "constant", "params": {"value": ""}}]}]}]}
    assert "a\\u0026b" in canonical_json(spec)


@pytest.mark.parametrize("text", ["", "nil", "[]", "7", '"x"', "{}", '{"databases": {}}', '{"databases": []}',
                                  json.dumps(doc()) + json.dumps(doc()), json.dumps({**doc(), "extra": 1}),
                                  json.dumps(doc(database={"optional": "yes"})), json.dumps(doc(database={"pre": ["tidy"]})),
                                  json.dumps(doc()).ljust(MAX_POLICY_BYTES + 1)])
def test_documents_that_are_no_policy(text):
    with pytest.raises(PolicyError):
        decode(text)


def test_a_document_of_the_greatest_size_is_read():
    assert decode(json.dumps(doc()).ljust(MAX_POLICY_BYTES))[0]["databases"][0]["name"] == "shop"


def table(**fields):
    return doc(tables=[{"name": "visits", "columns": [RULE], **fields}])


@pytest.mark.parametrize("spec,place", [
    (doc(determinism={"mode": "perrun"}), "determinism.mode"),
    (doc(determinism={"mode": "Fixed", "seedSecretRef": {"name": "seed"}}), "determinism"),
    (doc(defaults={"pageSize": MAX_PAGE_SIZE + 1}), "defaults.pageSize"),
    (doc(defaults={"onEmpty": "Never"}), "columns[0]"),
    (doc(steps=[{"name": "a", "secretKeyRef": {"name": "n", "key": "k"}}] * 2), "steps"),
    (doc(steps=[{"name": "a"}]), "steps[0]"),
    (doc(steps=[{"configMapKeyRef": {"name": "n", "key": "k"}}]), "steps[0].name"),
    (doc(steps=[{"name": "a", "secretKeyRef": {"key": "k"}}]), "steps[0].secretKeyRef"),
    (doc(steps=[{"name": "a", **{r: {"name": "n", "key": "k"} for r in ("secretKeyRef", "configMapKeyRef")}}]), "steps[0]"),
    (doc(database={"name": None}), "databases[0]"), (doc(database={"namePattern": "s.*"}), "databases[0]"),
    (doc(database={"name": None, "namePattern": "s["}), "namePattern"), (doc(database={"post": [{"name": "tidy"}]}), "databases[0]"),
    (table(name=""), "tables[0].name"), (doc(tables=[{"name": "t", "columns": [RULE]}] * 2), "tables"),
    (table(action="Empty"), "action"), (table(action="Truncate"), "tables[0]"), (table(columns=[]), "tables[0]"),
    (table(columns=[RULE, RULE]), "columns"), (table(columns=[{"strategy": "text"}]), "columns[0].name"),
    (table(pageSize=0), "pageSize"), (table(pageSize=MAX_PAGE_SIZE + 1), "pageSize"),
    (table(ignore={"where": "\t"}), "where"), (table(ignore={"where": "a = ';'"}), "where"),
    (table(ignore={"where": "é" * 2049}), "where"), (table(ignore={}), "where"),
])
def test_findings_name_their_place(spec, place):
    _, wrong = findings(spec)
    assert any(f.split(": ")[0].endswith(place) for f in wrong), wrong
    with pytest.raises(PolicyError):
        decode(spec)


def test_all_findings_are_reported():
    spec = doc(tables=[{"name": "", "pageSize": 0, "columns": [{"name": "a", "strategy": "digits", "params": {"length": 0, "case": "x"}}]}],
               determinism={"mode": "no"})
    with pytest.raises(PolicyError) as failure:
        validate(spec)
    assert failure.value.message.count("; ") == 4


def test_a_full_policy_and_a_pattern_are_fine():
    assert decode(full())[0]["databases"][0]["tables"][1]["action"] == "Truncate"
    validate(doc(database={"name": None, "namePattern": "shop_[a-z]+"}))
    validate(table(ignore={"where": "é" * 2048}))


EDGES = [(s, name, p.between) for s, spec in PARAMS.items() for name, p in spec.items() if p.between]
EDGES += [(s, "length", (1, 4096)) for s in ("city", "uuid", "text")] + [("hash", "length", (1, 64))]


@pytest.mark.parametrize("strategy,name,edges", EDGES)
def test_ranges_hold_at_their_edges(strategy, name, edges):
    other = {"min": {"max": 2**63 - 1}, "max": {"min": -(2**63)}}.get(name, {})
    for value, fine in ((edges[0] - 1, False), (edges[0], True), (edges[1], True), (edges[1] + 1, False)):
        rule = {"strategy": strategy, "params": {**NEEDED.get(strategy, {}), **other, name: value}}
        if fine:
            assert compile_rule(rule).params[name] == value
        else:
            with pytest.raises(PolicyError):
                compile_rule(rule)


@pytest.mark.parametrize("strategy,name,choices", [(s, n, p.choices) for s, spec in PARAMS.items() for n, p in spec.items() if p.choices])
def test_choices(strategy, name, choices):
    for value in choices:
        assert compile_rule({"strategy": strategy, "params": {**NEEDED.get(strategy, {}), name: value}}).params[name] == value
    with pytest.raises(PolicyError):
        compile_rule({"strategy": strategy, "params": {**NEEDED.get(strategy, {}), name: "other"}})


@pytest.mark.parametrize("strategy,params", [
    ("digits", {}), ("alphanumeric", {}), ("constant", {}), ("constant", {"value": "", "valueFrom": {"name": "n", "key": "k"}}),
    ("constant", {"valueFrom": {"key": "k"}}), ("number", {"min": 101}), ("hash", {"encoding": "base64", "length": 45}),
    ("date", {"from": "2001-02-29"}), ("date", {"from": "20010228"}), ("date", {"to": "1949-12-31"}), ("mask", {"maskChar": "##"}),
    ("email", {"domain": "two words.example"}), ("email", {"domain": "a..example"}), ("email", {"domain": "x/y.example"}),
    ("email", {"domain": "größe.example"}), ("city", {"locale": "fr"}), ("no_such", {}),
])
def test_parameters_that_do_not_fit(strategy, params):
    with pytest.raises(PolicyError):
        compile_rule({"strategy": strategy, "params": params})


def test_defaults_of_rules():
    assert len(STRATEGIES) == 29
    for strategy in STRATEGIES:
        rule = compile_rule({"name": "c", "strategy": strategy, "params": NEEDED.get(strategy, {})}, {"onNull": "Generate"})
        assert (rule.on_null, rule.on_empty) == ("Generate", "Keep") and rule.keyed == (strategy not in UNKEYED)
        for flag in (True, False):
            if strategy in UNKEYED:
                with pytest.raises(PolicyError):
                    compile_rule({"strategy": strategy, "params": NEEDED.get(strategy, {}), "consistent": flag})
            else:
                assert compile_rule({"strategy": strategy, "params": NEEDED.get(strategy, {}), "consistent": flag}).consistent is flag
    row_based = {s for s in STRATEGIES if not compile_rule({"strategy": s, "params": NEEDED.get(s, {})}).consistent}
    assert row_based == {"alphanumeric", "digits", "number", "text", "constant", "mask", "null"}
    mail = {"strategy": "email"}
    assert compile_rule(mail, {"emailDomain": "a.example"}).params["domain"] == "a.example"
    assert compile_rule({**mail, "params": {"domain": "größe.example", "ascii": False}}).params["domain"] == "größe.example"
    assert compile_rule({"strategy": "hash"}, {"locale": "fr"}).params["length"] == 64
    assert [page_size(*args) for args in (({"pageSize": 3}, {"pageSize": 4}, 5), ({}, {"pageSize": 4}, 5), ({}, {}, 5), ({}, None))] == [3, 4, 5, 5000]


@pytest.mark.parametrize("strategy,params,width", [
    ("hash", {"encoding": "base64"}, 44), ("hash", {"length": 20}, 20), ("digits", {"length": 31}, 31), ("phone", {"digits": 4}, 4),
    ("date", {}, 10), ("date", {"format": "datetime"}, 19), ("uuid", {}, 36), ("vatId", {}, 11), ("iban", {}, 22), ("company", {}, None),
])
def test_output_width(strategy, params, width):
    assert compile_rule({"strategy": strategy, "params": params}).output_length() == width


def test_old_spellings():
    assert len(LEGACY_NAMES) == 26
    for old, strategy in LEGACY_NAMES.items():
        found, params = parse_legacy(old)
        assert found == strategy and params.get("case") == ("Upper" if old == "alphanumeric_upper_case" else None)
        if "length" in PARAMS.get(strategy, {}):
            assert parse_legacy(f"{old}(4096)")[1]["length"] == 4096
        else:
            with pytest.raises(PolicyError):
                parse_legacy(f"{old}(8)")
    for wrong in ("digits(0)", "digits(4097)", "digits( 5)", "digits(5", "digits()", "", "no_such(5)"):
        with pytest.raises(PolicyError):
            parse_legacy(wrong)
