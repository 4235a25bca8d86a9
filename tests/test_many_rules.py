"""Thousands of rules give what one expression for each gives."""

import random
import time

from checks import registry
from seclog import refdata as R
from seclog.operators import annotate as A

SCHEMA = "ord int, name string, pattern string, severity string"


def rules(n, seed=1):
    rng = random.Random(seed)
    syllables = "ka lo mi ru te su na vo fi po gre sha".split()
    out = [(r.name, r.pattern) for r in R.RULES]
    while len(out) < n:
        word = "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
        form = rng.choice(["{w}", r"{w}\s+\d+", "({w}|{v}) from", r"^{w}.*port", r"\b{w}[0-9]*\b", "session|{w}x"])
        out.append((f"rule {len(out)}", form.format(w=word, v=word[::-1])))
    return out


def test_equal_to_one_expression_per_rule(spark, sf):
    rows = registry.entries(spark, sf)
    listed = rules(300) + [("no text", r"\d{5}"), ("one letter", "[a-z]q"), ("broken", "a("), ("kelvin", "failed paſsword"), ("again", "failed password")]
    table = spark.createDataFrame([(i, n, p, "high") for i, (n, p) in enumerate(listed)], SCHEMA)
    many = {r.id: r.matched_rules for r in A.match_rules_table(rows, table, per_expression=10).collect()}
    one = {r.id: r.matched_rules for r in A.match_rules_table(rows, table, per_expression=1000).collect()}
    assert many == one and len(one) > 100 and max(map(len, one.values())) > 2
    assert A.match_many_rules(rows, []).count() == 0 and A.match_many_rules(rows.limit(0), [R.Rule("a", "abc", "high")]).count() == 0


def test_time_follows_the_texts(spark):
    rows = registry.entries(spark, "/root/testdata/sf0.01")
    few = spark.createDataFrame([(i, r.name, r.pattern, r.severity) for i, r in enumerate(R.RULES)], SCHEMA)
    lots = spark.createDataFrame([(i, n, p, "high") for i, (n, p) in enumerate(rules(5000))], SCHEMA)
    took = []
    for table in (few, lots, few, lots):
        began = time.time()
        A.match_rules_table(rows, table).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[3] < 10 * took[2] + 5
