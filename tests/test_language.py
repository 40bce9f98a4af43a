import math

import pytest

from kinetrace.functions import kernels as K
from kinetrace.functions.selection import Atom, SelectionError, resolve
from kinetrace.functions.units import parse_angle, parse_area, parse_distance, parse_duration, standard_atomic_mass_da
from kinetrace.plans.language import Logic, QueryError, Relation, Repeats, event_type, parse, render
from kinetrace.plans.planner import explain, validate
from kinetrace.sources.topology import Topology

SIMPLE = [Atom(0, "CA", "ARG", 17, "A", "C"), Atom(1, "CB", "ARG", 17, "A", "C"), Atom(2, "CA", "ASP", 42, "A", "C"), Atom(3, "CA", "GLU", 53, "B", "C"), Atom(4, "O", "HOH", 99, "W", "O")]
TOPOLOGY = Topology.of(SIMPLE)


def test_units():
    assert parse_distance("10A") == 1.0 and parse_duration("5ns") == 5000 and parse_duration("10fs") == 0.01
    assert math.isclose(parse_angle("3.14159265358979323846rad"), 180) and parse_area("100A2") == 1.0
    assert parse_duration("2NS") == 2000 and parse_distance("2a") == 0.2
    assert parse_distance("3A") == 3 * 0.1 != 0.3
    with pytest.raises(ValueError, match="Distance expected, received time unit 'ns'"):
        parse_distance("2ns")
    with pytest.raises(ValueError, match="Time expected, received distance unit 'nm'"):
        parse_duration("2nm")
    for bad in ("5", "1e3nm", "nm", "1 parsec"):
        with pytest.raises(ValueError):
            parse_distance(bad)
    assert standard_atomic_mass_da("c") == 12.011 and standard_atomic_mass_da("XX") == 0.0


@pytest.mark.parametrize(("text", "count"), [("resid 17", 2), ("resid 17:42", 3), ("name CA", 3), ("resname ARG", 2), ("chain B", 1), ("protein", 4), ("resid 17 and name CA", 1), ("resname ARG or resname GLU", 3), ("protein and not hydrogen", 4), ("name CA or name CB and chain B", 3), ("(name CA or name CB) and chain B", 1), ("NOT not ResID 17", 2)])
def test_selections(spark, text, count):
    from kinetrace.functions.selection import predicate

    found = resolve(text, SIMPLE)
    assert len(found) == count
    own = TOPOLOGY.atoms_frame(spark).where(predicate(text)).orderBy("atom_index").collect()
    assert [r.atom_index for r in own] == found


@pytest.mark.parametrize(("text", "message"), [("resid foo", "Unknown residue selection: foo"), ("resid 999", "matched zero atoms"), ("resid 17 and", "Malformed selection"), ("resid 5:2", "Residue range start exceeds end"), ("chain AB", "expects one character"), ("name ca", "zero atoms"), ("(protein", "Malformed"), ("protein protein", "Malformed"), ("", "Malformed")])
def test_selection_errors(text, message):
    with pytest.raises(SelectionError, match=message):
        resolve(text, SIMPLE)


@pytest.mark.parametrize(("text", "message"), [
    ("FIND CONTACT(resid 1)", "CONTACT requires two selections"), ("FIND DISTANCE(a)", "DISTANCE requires exactly two selections"), ("FIND NOPE(a)", "Unknown observable: NOPE"),
    ("FIND CONTACT(a,b) SOON CONTACT(a,b)", "Unknown temporal operator: SOON"), ("FIND CONTACT(a,b) 12", "Unexpected query text: 12"), ("FIND CONTACT(a,b", "Unclosed"),
    ("FIND CONTACT(a,b) > 1nm", "already boolean"), ("FIND DISTANCE(a,b) < 2ns", "Distance expected"), ("FIND CONTACT(a,b) FOR > 1ns", "FOR currently requires '>='"),
    ("FIND CONTACT(a,b) REPEATS >= 0", "unitless positive integer"), ("FIND CONTACT(a,b) REPEATS >= 1.5", "Unexpected|Expected"), ("FIND CONTACT(a,b,cutoff=1nm,cutoff=2nm)", "Duplicate CONTACT cutoff option"),
    ("FIND CONTACT(a,b,mode=atom)", "Unknown CONTACT option: mode"), ("FIND CONTACT_COUNT(a,b,mode=x) > 1", "CONTACT_COUNT mode must be 'atom' or 'residue'"), ("FIND CONTACT(a,b,-1nm)", "Contact cutoff must be non-negative"),
    ("FIND HBOND(a,b,0.3nm)", "Expected named HBOND option"), ("FIND RMSD(a,align=maybe) < 1nm", "must be true or false"), ("FIND SASA(a,points=5) > 1nm2", "at least six"), ("FIND HELIX(a,minimum_fraction=2)", "between 0 and 1"),
    ("FIND ORIENTATION(a,b) < 1deg", "axis=x"), ("FIND AROMATIC_STACKING(a,b,max_angle=91deg)", "must not exceed 90"), ("CONTACT(a,b)", "Expected 'FIND'"), ("FIND (CONTACT(a,b)", "Expected '\\)'"),
])
def test_parse_errors(text, message):
    with pytest.raises(QueryError, match=message):
        validate(text)


def test_grammar():
    q = parse("find event where CONTACT(resid 1, (resid 2 or resid 3)) and DISTANCE(a,b) >= 3A for >= 1ns")
    assert isinstance(q, Logic) and q.right.operand.threshold == 3 * 0.1
    q = parse("FIND CONTACT(a,b) FOLLOWED_BY CONTACT(a,c) REPEATS >= 2 WITHIN 3ns;")
    assert isinstance(q, Relation) and q.within is None and q.right == Repeats(q.right.operand, 2, 3000.0)
    assert render(parse("FIND CONTACT(a , b) FOLLOWED_BY SASA(c) > 2nm2 WITHIN 3ns")) == "(CONTACT(a, b, cutoff=0.45nm) FOLLOWED_BY SASA(c, probe=0.14nm, points=96) > 2nm2 WITHIN 3000ps)"
    assert event_type(parse("FIND CONTACT(resid 17, resid 42)")) == "CONTACT(resid 17,resid 42)"
    assert event_type(parse("FIND RG(protein) > 2nm")) == "RG(protein)#CMP2:2.000000"
    assert event_type(parse("FIND SALT_BRIDGE(z,a) AND CONTACT(z,a,0.3nm)")) == "(SALT_BRIDGE(a,z,cutoff=0.4nm)&CONTACT(z,a,cutoff=0.3nm))"


def test_explain_and_type_rules():
    x = explain("FIND CONTACT(resid 17, resid 42) FOLLOWED_BY CONTACT(resid 17, resid 53) WITHIN 3ns", TOPOLOGY)
    assert x["streaming"] is True and len(x["observables"]) == 2 and x["selections"] == ["resid 17", "resid 42", "resid 53"]
    assert x["temporal_operations"] == ["FOLLOWED_BY WITHIN 3000ps"] and len(x["frame_predicates"]) == 2
    assert x["plan_tree"].splitlines()[1].startswith("  CONTACT: ")
    assert len(explain("FIND DISTANCE(resid 17, resid 42) > 1nm AND DISTANCE(resid 42, resid 17) < 2nm", TOPOLOGY)["observables"]) == 1
    for text, message in (("FIND RG(protein)", "Query root must produce events"), ("FIND CONTACT(resid 17, resid 42) AND CONTACT(resid 17, resid 42) FOR >= 1ns", "AND requires frame-predicate"), ("FIND RG(protein) FOR >= 1ns", "FOR requires an event-producing"), ("FIND RG(protein) BEFORE CONTACT(resid 17, resid 42)", "BEFORE requires event-producing"), ("FIND DIHEDRAL(name CA, resid 42, resid 42, resid 53) > 1deg", "exactly one atom"), ("FIND AROMATIC_STACKING(resid 17, protein)", "at least three atoms"), ("FIND HBOND(protein, protein)", "no explicitly bonded hydrogen")):
        with pytest.raises(QueryError, match=message):
            explain(text, TOPOLOGY)
    odd = Topology.of([Atom(0, "X", "LIG", 1, "A", "XX"), Atom(1, "C", "LIG", 1, "A", "C")])
    for text, message in (("FIND SASA(name C) > 1nm2", "no van der Waals radius"), ("FIND RG(resid 1, mass_weighted=true) > 1nm", "known positive mass")):
        with pytest.raises(QueryError, match=message):
            explain(text, odd)


def test_minimum_image():
    assert math.isclose(K.minimum_image_distance([0.1, 0, 0], [1.9, 0, 0], [2, 2, 2]), 0.2)
    assert math.isclose(K.minimum_image_distance_cell([0.1, 0, 0], [1.9, 0, 0], [[2, 0.1, 0], [0, 2, 0], [0, 0, 2]]), math.sqrt(0.05), rel_tol=1e-9)
    with pytest.raises(ValueError):
        K.minimum_image_distance([0, 0, 0], [1, 0, 0], [1, 0, 1])


def test_helpers():
    import kinetrace
    from kinetrace.sources.topology import Topology

    assert kinetrace.parse_query("FIND CONTACT(resid 1, resid 2)") == 0 and kinetrace.parse_query("FIND RG(protein) < 1nm") == 14
    assert kinetrace.parse_query("FIND CONTACT(resid 1, resid 2) FOLLOWED_BY CONTACT(resid 1, resid 3)") == 17 and kinetrace.parse_query("FIND CONTACT(resid 1, resid 2) OR CONTACT(resid 1, resid 3)") == 26
    assert kinetrace.distance((0, 0, 0), (0.3, 0.4, 0)) == 0.5 and kinetrace.parse_duration_ps("2ns") == 2000
    top = Topology.parse_pdb(["ATOM      1  CA  ARG A   1       0.000   0.000   0.000  1.00  0.00           C", "ATOM      2  CA  ASP A   2       3.000   0.000   0.000  1.00  0.00           C"])
    assert kinetrace.explain_query(top, "FIND CONTACT(resid 1, resid 2)") == kinetrace.explain("FIND CONTACT(resid 1, resid 2)", top)
