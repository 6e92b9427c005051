import random

from pagewright.llm import boilerplate as B

SUBJECTS, VERBS, OBJECTS = "mayor judge teacher doctor choir gardener".split(), "opened painted sold found carried praised".split(), "bridge roof garden clock letter kettle boat tower lamp organ map fence".split()

TOWNS = [a + b for a in ("Hal", "Ter", "Vor", "Kas", "Lin", "Mol") for b in ("ford", "burg", "stadt", "gate", "wick", "dal", "holt")]


def body(pick):
    return " ".join(f"The {pick.choice(SUBJECTS)} {pick.choice(VERBS)} the {pick.choice(OBJECTS)} near number {pick.randrange(99)} of {pick.choice(['April', 'Lane', 'Street'])} {pick.randrange(10**6)} with the {pick.choice(OBJECTS)}." for _ in range(6))


def pages(n, site=1):
    pick, rows, wanted = random.Random(site), [], set()
    for i in range(n):
        key = site * 1000 + i
        parts = ["<h1>Title</h1>", f"<p>{body(pick)}</p>", f"<ul><li>the {pick.choice(OBJECTS)}</li><li>the {pick.choice(OBJECTS)}</li></ul>", f"<p>{body(pick)}</p>"]
        if i % 3:
            del parts[2]
        extra = [
            "<ul><li>" + "</li><li>".join(pick.sample(["Sport", "Weather", "Opinion", "Contact"], 3)) + "</li></ul>",
            "<p>Subscribe to the letter of The Site today.</p>",
            f"<p>Read also: The {pick.choice(SUBJECTS)} sold the {pick.choice(OBJECTS)} in {pick.choice(TOWNS)}</p>",
            "<p>We use cookies to measure our reach.</p>",
            "<p>© 2020 The Site. All rights reserved.</p>",
        ]
        for e in pick.sample(extra, 2):
            parts.insert(pick.randrange(len(parts) + 1), e)
        at = pick.randrange(len(parts) + 1)
        parts[at:at] = ["<h3>Latest</h3>", f"<ul><li>The {pick.choice(SUBJECTS)} {pick.choice(VERBS)} the {pick.choice(OBJECTS)} in {pick.choice(TOWNS)}</li><li>{pick.choice(TOWNS)}: a {pick.choice(OBJECTS)} {pick.choice(VERBS)}</li></ul>"]
        wanted |= {(key, k + 1) for k, p in enumerate(parts) if p in extra or p.startswith("<h3>") or (k and parts[k - 1].startswith("<h3>"))}
        rows.append({"article_id": key, "site_id": site, "content": "<p>x</p>", "plain_content": "<div>\n" + "\n".join(parts) + "\n</div>", "plain_text": []})
    return rows, wanted


def sites(spark):
    return spark.createDataFrame([(1, "The Site", "en", "x"), (1, "The Site", "en", "x"), (2, "Other", "en", "y")], "site_id int, site_name string, lang string, title string")


def test_elements(spark, articles):
    rows, wanted = pages(120)
    rows += [rows[0], {"article_id": 9, "site_id": 1}, {"article_id": 10, "site_id": None, "plain_content": "<div></div>"}, {"article_id": 11, "plain_content": ""}]
    got = {tuple(r) for r in B.boilerplate_elements(articles(rows), sites(spark)).collect()}
    assert got == wanted


def test_residue_gives_no_row_and_empty_tables_none(spark, articles):
    rows, _ = pages(120)
    bad = {**rows[0], "article_id": 77, "content": "<p>undefined</p>"}
    got = {r[0] for r in B.boilerplate_elements(articles([*rows, bad]), sites(spark)).collect()}
    assert 77 not in got and len(got) == 120
    assert B.boilerplate_elements(articles(rows).limit(0), sites(spark)).count() == 0


def test_bodies(spark, articles):
    rows, wanted = pages(120)
    bodies = {r["article_id"]: r["body"] for r in B.main_bodies(articles([*rows, {"article_id": 5}]), sites(spark)).collect()}
    assert bodies[5] is None and len(bodies) == 121
    assert all("Latest" not in b and "Sport" not in b for k, b in bodies.items() if k != 5)
    assert sum("<li>the " in b for b in bodies.values() if b) == 40


def test_children_and_atoms():
    assert B.children("<div>\n<p>a <b>c</b></p><br/>\n<ul><li>x</li></ul></div>") == [("p", "a <b>c</b>"), ("br", ""), ("ul", "<li>x</li>")]
    assert B.children(None) == B.children("") == []
    assert B.atoms_of("p", "Share this Save for later", None) == [("Share this", False), ("Save for later", False)]
    assert B.atoms_of("p", "Read also: Town: a thing", None) == [("Read also:", False), ("Town: a thing", True)]
    assert B.atoms_of("pre", "x", None) == B.atoms_of("p", "word " * 200, None) == []


def test_an_article_delivered_often_counts_once(spark, articles):
    rows, wanted = pages(120)
    got = {tuple(r) for r in B.boilerplate_elements(articles(rows + rows[:1] * 150 + rows[1:2] * 150), sites(spark)).collect()}
    assert got == wanted


def test_elements_of_any_length(spark, articles):
    rows, wanted = pages(120)
    letters = "abcdefghijklmnopqrstuvwxyz"
    notice = " ".join(f"legal{a}{b}" for a in letters[:9] for b in letters[:9]) + "."
    links = "<ul>" + "".join(f'<li><a href="https://x.example/{"y" * 90}">Menu{a}{b}</a></li>' for a in letters[:9] for b in letters[:8]) + "</ul>"
    for k, r in enumerate(rows):
        n = len(B.children(r["plain_content"]))
        r["plain_content"] = r["plain_content"][: -len("\n</div>")] + f"\n<p>{notice}</p>\n{links}\n</div>"
        wanted |= {(r["article_id"], n + 1), (r["article_id"], n + 2)}
    assert {tuple(r) for r in B.boilerplate_elements(articles(rows), sites(spark)).collect()} == wanted
    same = "the old mill " * 60
    assert B._story(None, [("p", same + "burned")]) != B._story(None, [("p", same + "was sold")])


def test_spread_joins_give_the_same(spark, articles, monkeypatch):
    rows, wanted = pages(120)
    monkeypatch.setattr(B, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(B, "SALTS", 3)
    assert {tuple(r) for r in B.boilerplate_elements(articles(rows + rows[:2] * 3), sites(spark)).collect()} == wanted


def test_classes_of_equal_vectors(spark):
    """a and b stand on the same pages in one order; c and d too, but in either order; e and f cross."""
    rows = []
    for page in range(4):
        line = ["a", "x", "b"] if page % 2 else ["a", "b"]
        rows += [(1, page, h, i) for i, h in enumerate(line)]
    for page in range(10, 14):
        rows += [(1, page, h, i) for i, h in enumerate("cd" if page % 2 else "dc")]
    for page in range(20, 25):
        rows += [(1, page, h, i) for i, h in enumerate("efgh")]
        rows += [(1, page, h, 4) for h in ("u" if page < 24 else "v")]
    for page in range(30, 33):
        rows += [(1, page, h, i) for i, h in enumerate(["k", "l", "k", "l"])]
        rows += [(1, page, "only", 9)]
    schema = "unit bigint, article_id bigint, h string, place bigint"
    atoms = spark.createDataFrame(rows, schema).selectExpr("unit", "true AS own_host", "article_id AS story", "article_id", "place", "xxhash64(h) AS h", "h AS atom")
    names = {r["h"]: r["atom"] for r in atoms.select("h", "atom").distinct().collect()}
    classes, _ = B.equivalence_classes(atoms)
    found = {}
    for r in classes.collect():
        found.setdefault(r["cls"], set()).add(names[r["h"]])
    sets = sorted(map(sorted, found.values()))
    assert ["a", "b"] in sets and ["e", "f", "g", "h"] in sets
    assert ["c"] in sets and ["d"] in sets  # no common order
    assert ["k", "l"] in sets and ["only"] in sets  # as often on each page, or not
    assert not any("x" in s or "v" in s for s in sets)  # on too few pages


def test_classes_that_cross_fall_apart(spark):
    rows = []
    for page in range(3):
        rows += [(1, page, h, i) for i, h in enumerate(["p", "p", "q", "q", "p", "q"])]
    atoms = [(1, page, h, i) for page in range(3) for i, h in enumerate(["a", "c", "b", "d"])] + [(1, 9, "a", 0), (1, 9, "b", 1)] + [(1, 8, "c", 0), (1, 8, "d", 1)]
    frame = spark.createDataFrame(atoms, "unit bigint, article_id bigint, h string, place bigint").selectExpr("unit", "true AS own_host", "article_id AS story", "article_id", "place", "xxhash64(h) AS h")
    classes, _ = B.equivalence_classes(frame)
    assert classes.select("cls").distinct().count() == 4


def test_bodies_of_content(spark, articles):
    rows, _ = pages(120)
    for r in rows:
        inner = r["plain_content"][len("<div>") : -len("</div>")]
        r["content"] = f'<div class="page"><section>{inner}</section></div>'
    without = {**rows[3], "article_id": 500, "plain_content": None}
    got = {r["article_id"]: r for r in B.main_bodies(articles([*rows, without]), sites(spark)).collect()}
    told = lambda x: [(t, y) for t, y, _, _ in B.blocks_of(x)]
    for r in rows:
        assert told(got[r["article_id"]]["content_body"]) == B.children(got[r["article_id"]]["body"])
    assert got[500]["content_body"] == got[rows[3]["article_id"]]["content_body"] and got[500]["body"] is None
    assert got[500]["content_body"].startswith('<div class="page"><section>')


def test_template(spark, articles):
    rows, _ = pages(120)
    classes = {tuple(r["atoms"]): r for r in B.template_classes(articles(rows), sites(spark)).collect()}
    assert ("Sport",) in classes and ("Latest",) in classes and classes["Latest",]["stories"] == 120 and classes["Latest",]["host"] is None


def test_hosts_of_any_size_have_their_own_template_and_share_the_pools(spark, articles, monkeypatch):
    """The bulletin stands on 5 of 30 stories of a small host, too few for the pool; the partner line on 2 of 200 stories of a large host, too few for that host, but on enough of the pool."""
    monkeypatch.setattr(B, "POOL_SHARE", 0.1)
    monkeypatch.setattr(B, "OWN_HOST", 150, raising=False)  # the size from which hosts were taken out of the pool
    bulletin, partner = "<p>Bulletin delivered weekly.</p>", "<p>Partnerships welcomed everywhere.</p>"
    pick, rows, wanted = random.Random(4), [], set()
    for site, n, line, times in ((1, 30, bulletin, 5), (2, 200, partner, 2), (3, 30, partner, 28), (None, 2, partner, 2)):
        for i in range(n):
            key = (site or 9) * 1000 + i
            parts = ["<h1>Title</h1>", f"<p>{body(pick)}</p>", *([line] if i < times else [])]
            wanted |= {(key, 3)} if i < times and site else set()
            rows.append({"article_id": key, "site_id": site, "title": f"t{key}", "content": "<p>x</p>", "plain_content": "<div>\n" + "\n".join(parts) + "\n</div>"})
    sites = spark.createDataFrame([(k, f"Site{k}", "en") for k in (1, 2, 3)], "site_id int, site_name string, lang string")
    assert {tuple(r) for r in B.boilerplate_elements(articles(rows), sites).collect()} == wanted
    classes = {tuple(r["atoms"]): (r["host"], r["stories"]) for r in B.template_classes(articles(rows), sites).collect()}
    assert classes == {("Bulletin delivered weekly.",): (1, 5), ("Partnerships welcomed everywhere.",): (None, 30)}
