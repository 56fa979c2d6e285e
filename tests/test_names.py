from curata.functions.names import ColumnTrail, make_unique, spell, standardize_names


def test_spell():
    assert spell("  Total-Price ($) ") == "total_price_"
    assert spell("A b") == "a_b"
    assert spell("a-b") == "a_b"
    assert spell("a b ") == "a_b"
    assert spell("$") == ""


def test_make_unique_checks_generated_names():
    assert make_unique(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert make_unique(["a", "a", "a"]) == ["a", "a_2", "a_3"]
    assert make_unique(["A", "a"]) == ["A", "a_2"]        # case-insensitive in Spark
    assert make_unique(["", ""]) == ["_", "__2"]


def test_standardize_names_collisions():
    assert standardize_names(["A b", "a-b", "a b ", "a_b_2", "$"]) == ["a_b", "a_b_3", "a_b_4", "a_b_2", "_"]


def test_spell_levels():
    assert spell(" 1-URGENT! ", symbols_part=True) == "1_urgent"
    assert spell("a (-b", symbols_part=True) == "a_b" and spell("a (-b") == "a__b"
    assert spell("__x__", symbols_part=True) == "x" and spell("Éà ß") == "éà_ß"


def test_column_trail():
    trail = ColumnTrail(["Old A", "B"])
    trail.rename(["old_a", "b"])
    assert trail.find(["Old A", "b", "zzz", "old_a"], ["old_a", "b"]) == ["old_a", "b"]
    assert trail.find(None, ["old_a"]) == []
    trail.keep(["b"])
    assert trail.find(["Old A", "B"], ["b"]) == ["b"]
