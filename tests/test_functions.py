"""Behaviours of the column expressions on small frames."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievelake.functions import parse, taxonomy, text
from sievelake.sources import html_text

NOW = datetime(2024, 6, 30)


def one(spark, column, kind="string", *values):
    """The column over a frame of values, as a list."""
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {kind}" if " " in kind else f"i int, v {kind}")
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_clean_text(spark):
    assert one(spark, text.clean_text(F.col("v")), "string", None, "", "  a\t\n b  c ", "x") == ["", "", "a b c", "x"]
    assert one(spark, text.clean_text(F.col("v"), 3), "string", "abcdef", "a  b  c") == ["abc", "a b"]


def test_links(spark):
    assert one(spark, text.absolute_url(F.col("v"), "https://b.x/"), "string", None, "", "http://a", "//c/d", "/e", "f") == ["", "", "http://a", "https://c/d", "https://b.x/e", "https://b.x/f"]
    assert one(spark, text.strip_tracking(F.col("v")), "string", None, "u?x=1?y", "u") == ["", "u", "u"]
    links = ["https://x/y-acme-3812345678/", "https://x/y-acme-12", "12345678", "https://x/none", None]
    assert one(spark, text.id_from_link(F.col("v")), "string", *links) == ["3812345678", "12", "12345678", None, None]
    assert one(spark, text.id_from_link(F.col("v"), 8), "string", *links) == ["3812345678", None, "12345678", None, None]
    assert one(spark, text.search_url("https://b", F.col("v"), F.lit(3), "bangalore"), "string", "Python developer") == ["https://b/python-developer-jobs-in-bangalore-3"]
    assert one(spark, text.search_url("https://b", F.col("v"), F.lit(1)), "string", "C++ / dev!") == ["https://b/c-dev-jobs"]


def test_split_and_case(spark):
    assert one(spark, text.split_csv(F.col("v")), "string", None, "a, b|c / d,,", "CI/CD") == [[], ["a", "b", "c", "d"], ["CI", "CD"]]
    words = ["node.js", "o'neil", "3d", "hELLO wORLD", "c++"]
    assert one(spark, text.title_case(F.col("v")), "string", *words) == [w.title() for w in words]


def test_fingerprint_and_blob(spark):
    fp = text.fingerprint(F.col("t"), F.col("c"), F.col("l"))
    a, b, c = one(spark, fp, "t string, c string, l string", ("Dev!", "A.C", "Bengaluru, KA"), ("dev", "a c", "bengaluru"), ("dev", "a c", "Bangalore/Bengaluru"))
    assert a == b != c
    blob = text.search_blob(F.lit("T"), F.lit("C"), F.lit(""), F.lit(None).cast("string"), F.array(F.lit(" Go "), F.lit("")))
    assert one(spark, blob, "int", 1) == ["t c |go|"]


@pytest.mark.parametrize(
    ("value", "bounds"),
    [("0-3 Yrs", (0, 3)), ("2 to 5 years", (2, 5)), ("5 – 2 yrs", (2, 5)), ("Fresher", (0, 1)), ("Entry level", (0, 1)), ("Fresher (0-2 yrs)", (0, 2)), ("5+ years", (5, 7)), ("3 years", (3, 3)), ("", None), ("08 Aug", None), (None, None)],
)
def test_experience(spark, value, bounds):
    assert [tuple(r) if r else None for r in one(spark, parse.experience(F.col("v")), "string", value)] == [bounds]


def test_experience_in_prose(spark):
    cases = {
        "Needs minimum 11+ year(s) on ships": (11, None),
        "9 years of professional experience with looms": (9, None),
        "From 0-2 years of experience in weaving": (0, 2),
        "3–6 yrs; mostly on night shifts": (3, 6),
        "Even freshers may write to us": (0, 1),
        "4+ years at sea. 7+ years ashore are a plus.": (4, None),
        "Crew of 6-12, pay 9-11 LPA, 2-3 harbours": None,
        "Any 3 year diploma from a good college": None,
        "": None,
    }
    got = one(spark, parse.experience_in_prose(F.col("v")), "string", *cases)
    assert [tuple(r) if r else None for r in got] == list(cases.values())


def test_resolve_experience(spark):
    col = parse.resolve_experience(F.col("x"), F.col("t"), F.col("d"))
    rows = [("0-2 Yrs", "Engineer", "requires 9+ years"), ("Mid-Senior level", "", ""), ("Associate", "", ""), ("Not Applicable", "Engineer", "Minimum 10+ year(s)"), ("Not Applicable", "", ""), ("", "Trainee", "")]
    assert [tuple(r) if r else None for r in one(spark, col, "x string, t string, d string", *rows)] == [(0, 2), (5, None), (1, 3), (10, None), None, (0, 1)]


def test_salary(spark):
    got = one(spark, parse.salary(F.col("v")), "string", "3-5 Lacs PA", "1.5 Cr", "Not disclosed", "8 lpa", "", None, "Unpaid 2 lakh", "7 to 4 lakh")
    assert [tuple(r) for r in got] == [(3e5, 5e5), (1.5e7, 1.5e7), (None, None), (8e5, 8e5), (None, None), (None, None), (None, None), (4e5, 7e5)]


def test_dates(spark):
    days = lambda n: NOW - timedelta(days=n)
    cases = {"Just now": NOW, "5 hours ago": NOW, "1 hour ago": NOW - timedelta(hours=1), "yesterday": days(1), "30+ days ago": days(30), "2 weeks": days(14), "a month ago": days(30), "soon": None, "": None}
    assert one(spark, parse.relative_date(F.col("v"), F.expr("TIMESTAMP_NTZ '2024-06-30 00:00:00'")), "string", *cases) == list(cases.values())
    iso = {"2024-05-01": datetime(2024, 5, 1), "2024-05-01T10:00:00Z": datetime(2024, 5, 1, 10), "2024-05-01T10:00:00+05:30": datetime(2024, 5, 1, 4, 30), "2024-05-01 junk": datetime(2024, 5, 1), "2024": None, "2024-13-45": None, None: None}
    assert one(spark, parse.iso_date(F.col("v")), "string", *iso) == list(iso.values())
    epoch = {"1714521600000": datetime(2024, 5, 1), "1714521600": datetime(2024, 5, 1), "0": None, "-4": None, "x": None, None: None}
    assert one(spark, parse.epoch(F.col("v")), "string", *epoch) == list(epoch.values())


def test_skills(spark):
    col = taxonomy.extract_skills(F.col("v"))
    texts = ["Florist who knows some HTML", "All data is in PostgreSQL.", "C#, .NET, React; also C++ and Node.js", "Apps in React Native", "Drivers are written in C here", "Baker of basic bread", ""]
    assert one(spark, col, "string", *texts) == [["HTML"], ["PostgreSQL"], [".NET", "C#", "C++", "Node.js", "React"], ["React Native"], ["C"], [], []]


def test_merge_tags(spark):
    col = taxonomy.merge_tags(F.array(F.lit("Python")), F.split("v", ","))
    assert one(spark, col, "string", "python,node.js,NODE.JS,x,zarnix suite") == [["Python", "Node.Js", "Zarnix Suite"]]
    many = ",".join(f"tag{i}" for i in range(30))
    assert len(one(spark, col, "string", many)[0]) == 13


def test_is_tech(spark):
    col = taxonomy.is_tech(F.col("t"), F.col("d"), F.col("s"))
    yes = ["Web Developer II", "SRE", "Help Desk Night Shift", "ABAP Person", "Sysadmin", "Security Analyst East", "DBA", "QA Engineer", "Consultant - Cloud", "Product Designer", "Mobile Developer, Sales Tools", "Trainee - Software"]
    no = ["Flower Shop Owner", "Sales Lead East", "Payroll Clerk", "Accountant (Night)", "Mechanical Engineer, Pumps", "Back Office Helper", "Nurse in Charge", "Engineer Trainee", ""]
    kind = "t string, d string, s array<string>"
    assert one(spark, col, kind, *[(t, "", []) for t in yes]) == [True] * len(yes)
    assert one(spark, col, kind, *[(t, "", []) for t in no]) == [False] * len(no)
    more = [("Graduate Engineer Trainee", "", ["AutoCAD"]), ("Graduate Engineer Trainee", "", ["Java", "SQL"]), ("Associate", "", ["Python", "AWS"]), ("Wizard", "software developer", list("abcd"))]
    assert one(spark, col, kind, *more) == [False, True, True, True]


def test_categories(spark):
    rows = {
        ("Fullstack person", "Vue, Django"): "Full Stack",
        ("Data Analyst East", "Tableau and ETL"): "Data Engineering / Analytics",
        ("SOC Analyst, nights", "Splunk and a threat desk"): "Cybersecurity",
        ("iOS person", "Swift, some Flutter"): "Mobile Development",
        ("Tester", "Selenium"): "QA / Testing",
        ("SRE at sea", "Ansible, Docker"): "DevOps / Cloud / SRE",
        ("Data Scientist", "NLP"): "Data Science / AI-ML",
        ("Lighthouse keeper", "lamps"): "Other",
        ("Backend and Frontend", ""): "Full Stack",
    }
    scores = taxonomy.category_scores(F.col("t"), F.array().cast("array<string>"), F.col("d"))
    assert one(spark, taxonomy.best_category(scores), "t string, d string", *rows) == list(rows.values())
    assert one(spark, taxonomy.top_categories(scores), "t string, d string", ("Backend", "docker")) == [["Backend"]]


def test_seniority_and_mode(spark):
    col = taxonomy.seniority(F.col("t"), F.col("x"), F.col("y"))
    rows = [("Software Engineer Intern", "", None), ("Senior Backend Engineer", "8-12 Yrs", 8), ("Tech Lead", "", None), ("Software Engineer", "", 0), ("Software Engineer", "", 2), ("Software Engineer", "", 4), ("Dev", "Fresher", 5), ("Dev", "", None), ("Dev", "", 9)]
    assert one(spark, col, "t string, x string, y int", *rows) == ["intern", "senior", "lead", "fresher", "junior", "mid", "fresher", "mid", "lead"]
    mode = taxonomy.work_mode(F.col("l"), F.col("t"), F.col("d"))
    assert one(spark, mode, "l string, t string, d string", ("Remote", "Dev", ""), ("Hybrid - Pune", "", "remote work"), ("Pune", "", "x" * 600 + " remote")) == ["remote", "hybrid", "onsite"]


def test_startups(spark):
    blocked = ["TCS Pune", "Wipro East", "Capgemini Two", "KPMG Home", "Goldman Sachs Ltd", "Best Staffing", "Placement Friends"]
    assert one(spark, taxonomy.is_enterprise(F.col("v")), "string", *blocked, "Orchard Labs", "Quillbyte", None) == [True] * 7 + [False] * 3
    texts = ["An early-stage bakery", "After our Series B", "Ovens backed by locals", "As founding member you bake", "Bootstrapped since May", "Watch service startup on Mondays", "Edit start-up logs at night", "Our JVM startup is slow", None]
    assert [x is not None for x in one(spark, taxonomy.startup_signal(F.col("v")), "string", *texts)] == [True] * 5 + [False] * 4


def test_found_elements_are_those_of_a_walk():
    """The index finds what a walk over all elements does, in wild markup too."""
    rng = random.Random(4)
    tags, classes = ["div", "span", "a", "li", "br", "p"], ["x", "y", "x y", "", None]

    def walk(node):
        for c in node.children:
            if not isinstance(c, str):
                yield c
                yield from walk(c)

    for _ in range(150):
        page = ""
        for _ in range(rng.randint(0, 40)):
            tag, cls = rng.choice(tags), rng.choice(classes)
            page += rng.choice([f"<{tag} class='{cls}'>" if cls is not None else f"<{tag}>", f"</{tag}>", f"<{tag}/>", "text"])
        root = html_text.parse(page)
        for node in [root, *walk(root)]:
            for name in (None, *tags):
                for cls in (None, "x", "y", "z"):
                    want = [n for n in walk(node) if (name is None or n.name == name) and (cls is None or cls in n.attrs.get("class", "").split())]
                    assert node.find_all(name, cls) == want and node.find(name, cls) is (want[0] if want else None)


def test_plain_markup_gives_the_parsers_tree():
    """Pages of plain markup are read without HTMLParser, to the same tree; all others still go to it."""
    rng = random.Random(1)
    bits = ["<div>", "</div>", '<P class="a b">', "</p>", "<br>", "<br/>", '<img src="x&amp;y" alt>', "a &lt; b", " & ", "&am", "<!-- c -->", "<!---->", '<b\n id="q"  class="a">', "</B>", "<span/>", "t", "</ul>", "<li>"]
    wild = ["<", "<a href=x>", "<a b='c'>", "<script>", "</script>", "<!doctype html>", '<a b="c"d>', '<a a="1" A="2">', '"', "</a >"]

    def dump(n):
        return n.name, n.attrs, n.number, n.end, [c if isinstance(c, str) else dump(c) for c in n.children]

    read = 0
    for k in range(3000):
        page = "".join(rng.choice(bits if k % 3 else bits + wild) for _ in range(rng.randint(0, 12)))
        tree = html_text._Tree()
        tree.feed(page)
        tree.close()
        tree._close(0)
        assert dump(html_text.parse(page)) == dump(tree.root), page
        read += html_text._plain(page) is not None
    assert read > 1900


def test_a_page_read_leaves_no_circle_behind():
    import gc

    gc.collect()
    gc.disable()
    try:
        for page in ('<div class="x"><p>a</p></div>' * 50, "<div class=x><p>a</p></div>" * 50):
            assert html_text.to_text(page).startswith("a a")
        assert not [o for o in gc.get_objects() if isinstance(o, html_text.Node)]
    finally:
        gc.enable()


def test_prose_patterns_run_once(spark):
    """Each of the three patterns is mentioned as often as its matches are read, not again for each use of the result."""
    found = parse.experience_in_prose(F.col("d")).alias("p")
    df = spark.createDataFrame([("3 - 5 years of work, at least 2+ yrs, 4 years of experience",), ("a 4 year degree",), (None,)], "d string").select(found)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 3 and plan.count("split(") == 3
    assert [r.p for r in df.collect()] == [(2, None), None, None]
