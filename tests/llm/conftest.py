import pytest

#: Sentences of the kinds that labelled samples hold, made for these tests.
SENTENCES = {
    "en": ["The mayor of the town opened the new library, and many people came to the old square.", "She wrote that the river had never been so high in the spring.", "Nobody knows why the clock of the church stopped at half past seven."],
    "de": ["Der Bürgermeister der Stadt eröffnete die neue Bibliothek, und viele Leute kamen auf den alten Platz.", "Sie schrieb, dass der Fluss im Frühling noch nie so hoch gewesen sei.", "Niemand weiß, warum die Uhr der Kirche um halb acht stehen blieb."],
    "fr": ["Le maire de la ville a ouvert la nouvelle bibliothèque et beaucoup de gens sont venus sur la vieille place.", "Elle a écrit que la rivière n'avait jamais été aussi haute au printemps.", "Personne ne sait pourquoi l'horloge de l'église s'est arrêtée à sept heures et demie."],
    "es": ["El alcalde de la ciudad abrió la nueva biblioteca y mucha gente vino a la vieja plaza.", "Ella escribió que el río nunca había estado tan alto en primavera.", "Nadie sabe por qué el reloj de la iglesia se paró a las siete y media."],
    "ru": ["Мэр города открыл новую библиотеку, и много людей пришло на старую площадь.", "Она написала, что река весной никогда не была такой высокой.", "Никто не знает, почему часы церкви остановились в половине восьмого."],
}


@pytest.fixture(scope="session")
def samples(spark):
    return spark.createDataFrame([(k, s) for k, v in SENTENCES.items() for s in v * 2], "lang string, text string")


@pytest.fixture(scope="session")
def lexicon(spark):
    rows = [(k, w.strip(".,").lower(), i + 1) for k, v in SENTENCES.items() for i, w in enumerate(dict.fromkeys(" ".join(v).split()))]
    return spark.createDataFrame(rows, "lang string, word string, word_rank int")


@pytest.fixture(scope="session")
def sentences():
    return SENTENCES


BLOCK = "array<struct<text:string,node_index:string,content_digest:string>>"
ARTICLE = f"article_id bigint, site_id int, title string, byline string, content string, plain_content string, plain_text {BLOCK}, lang string, value string, field string"


@pytest.fixture(scope="session")
def articles(spark):
    """A function of rows as dicts to a table of articles with extra columns of clashing names; what a row leaves out is null."""

    def make(rows):
        names = [c.split(" ")[0] for c in ARTICLE.split(", ") if " " in c]
        full = [tuple(([(t, None, None) for t in r["plain_text"]] if n == "plain_text" and r.get(n) is not None else r.get(n)) for n in names) for r in rows]
        return spark.createDataFrame(full, ARTICLE)

    return make
