"""Spans that reach past the usual lengths."""

import random
import time

import pytest

from flowgrid.llm import pii

LONG = [
    "maximilian.featherstonehaugh @ mail.department.university-example.org",
    "anna-maria.von.der.heide.und.zu.lande @ a.b.mail.physics.uni-example.ac.uk",
    "bartholomew_montgomery.cholmondeley99 @ students.department-of-geography.example-university.edu",
    "a.b.c.d.e.f.g.h.i.j.k @ l.m.n.o.p.q.r.example.org",
]


@pytest.mark.parametrize("address", LONG)
@pytest.mark.parametrize("before,after", [("please write to ", " for more"), ("contact: ", "."), ("", ""), ('"', '" he said'), ("<", ">, or")])
def test_long_spaced_addresses_are_whole(address, before, after):
    text = before + address + after
    spans = pii.all_spans(text, pii.trained())[1]
    assert spans == [(len(before), len(before) + len(address), "email")]
    assert pii.redact(text, spans) == f"{before}[EMAIL]{after}"


def test_windows_do_not_cut_words():
    text = "x" * 60 + " " + "y" * 60 + " call 12 " + "z" * 60 + " end"
    assert all((a == 0 or not (text[a - 1] + text[a]).isalnum()) and (b == len(text) or not (text[b - 1] + text[b]).isalnum()) for a, b in pii.windows(text))


#: Lines written by hand, with what is personal in them; none of the forms' makers took part.
LINES = [
    ("Tel. 030 1234567 abends", "030 1234567"), ("Call (212) 555-0187 before noon.", "(212) 555-0187"), ("My number is 212-555-0187, ok?", "212-555-0187"), ("Fax: 212.555.0188", "212.555.0188"),
    ("card 4111-1111-1111-1112 declined", "4111-1111-1111-1112"), ("card: 4111 1111 1111 1112.", "4111 1111 1111 1112"), ("5500000000000005 is fake", "5500000000000005"), ("room 4 555-123-4567 or 555-765-4321", "555-123-4567|555-765-4321"),
    ("write to jane.doe @ example.org today", "jane.doe @ example.org"), ("mail bob99 @ mail.example.co.uk!", "bob99 @ mail.example.co.uk"), ("server 10.0.0.1:8080 is up", "10.0.0.1"), ("+49 (0)171 234 5678", "+49 (0)171 234 5678"),
    ("ISBN 978-3-16-148410-0 is out", ""), ("born 1987-05-12 in Rome", ""), ("at 10:45 on 12/03/2021", ""), ("order no. 2023-000123 shipped", ""), ("at 52.5200, 13.4050 we met", ""), ("version 2.10.3 of it", ""),
    ("EUR 1.234.567,89 paid", ""), ("population 83 200 000 in 2021", ""), ("pi is 3.14159265358979", ""), ("page 12-15 and 17-19", ""), ("id 123456789012", ""), ("tracking 1Z999AA10123456784", ""), ("year 2019 2020 2021 2022", ""),
]


def test_lines_written_by_hand():
    right = wrong = missed = 0
    for line, gold in LINES:
        want = set(filter(None, gold.split("|")))
        got = {line[a:b] for a, b, _ in pii.all_spans(line, pii.trained())[1]}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9


@pytest.mark.parametrize("mark,columns", [(" ", 10**6), (", ", 8), ("\t", 6)])
def test_numeric_tables_are_left_alone(mark, columns):
    """A million characters of numbers get no added span, in time that grows with their length."""
    rng = random.Random(1)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.randint(1, 5))) for _ in range(230_000)]
    text = "\n".join(mark.join(numbers[i : i + columns]) for i in range(0, len(numbers), columns))
    began = time.time()
    base, every = pii.all_spans(text, pii.trained())
    assert base == every and time.time() - began < 40
