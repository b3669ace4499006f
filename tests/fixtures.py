"""The 50-record event table and other small inputs."""

from __future__ import annotations

EXCLUSIVE = {"A": {"GA1", "GA2", "GA3", "GA4"}, "B": {"GB1", "GB2", "GB3", "GB4", "GB5", "GB6"}}
SCHEMA = "id long, item string, `group` string, year int"


def fifty():
    rows, n = [], 0

    def add(count, group, items, years=(2010, 2010)):
        nonlocal n
        for _ in range(count):
            n += 1
            rows.extend((n, i, group, y) for i, y in zip(items, years))

    for count, item in ((8, "Item01"), (4, "Item02"), (3, "Item03")):
        add(count, "B", [item])
    for count, item in ((8, "GA1"), (4, "Item05"), (3, "Item03")):
        add(count, "A", [item])
    add(10, "B", ["Item01", "Item02"])
    add(5, "A", ["GA1", "Item05"])
    add(3, "B", ["Item01", "GB1"])
    add(1, "A", ["Item03", "Item04"], (2010, 2015))
    add(1, "B", ["Item03", "Item04"], (2010, 2015))
    return rows


def planted(three: bool = False):
    """Records of planted labels: {S1,S2} in both groups, {A1,A2} in A, {B1,B2} in B (and C)."""
    rows, n = [], 0
    blocks = [("A", "S1 S2", 40), ("B", "S1 S2", 40), ("A", "A1 A2", 60), ("B", "B1 B2", 60)]
    if three:
        blocks = [(g, f"{g}1 {g}2", 14) for g in "ABC"] + [(g, "S1 S2", 8) for g in "ABC"]
    for g, items, count in blocks:
        for _ in range(count):
            n += 1
            rows += [(n, i, g, 2010) for i in items.split()]
    return rows


TRIANGLES = [("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0), ("d", "e", 1.0), ("d", "f", 1.0), ("e", "f", 1.0), ("c", "d", 0.1)]
