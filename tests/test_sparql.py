import pytest

from loomgraph.engine import Engine
from loomgraph.plans.sparql import SparqlError, parse

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def test_predicate_lists_and_literals():
    q = parse("""PREFIX x: <http://x.example/#>
      select distinct ?a ?b where { ?a x:n "one" ; x:m 'two'@en, "th\\"ree"^^x:t . # remark
        ?b a x:C . FILTER(?a != ?b) }""")
    assert q.distinct and q.variables == ["?a", "?b"]
    assert q.patterns == [
        ("?a", "<http://x.example/#n>", '"one"'),
        ("?a", "<http://x.example/#m>", '"two"@en'),
        ("?a", "<http://x.example/#m>", '"th\\"ree"^^<http://x.example/#t>'),
        ("?b", RDF_TYPE, "<http://x.example/#C>"),
    ]
    assert q.filters == [("?a", "!=", "?b")]


def test_blank_nodes_and_star():
    q = parse("PREFIX : <http://x/> SELECT * { ?d :t [ :u ?x ; :v 5 ] . _:k :w ?x . [] :z ?d LIMIT 3 }".replace(" LIMIT 3 }", " } LIMIT 3"))
    assert q.variables == ["?x", "?d"] and q.limit == 3
    assert len(q.patterns) == 5


def test_relative_iris():
    assert parse("BASE <http://b.example/dir/> SELECT ?x { ?x <p> <#q> }").patterns[0][1:] == ("<http://b.example/dir/p>", "<http://b.example/dir/#q>")


@pytest.mark.parametrize("text", [
    "SELECT ?d { ?d drug:target [ t:target ?x ] }",
    "SELECT ?x { ?x ?p ?y } ORDER BY ?x",
    "SELECT ?x { OPTIONAL { ?x ?p ?y } }",
    "SELECT ?x { { ?x ?p ?y } UNION { ?y ?p ?x } }",
    "ASK { ?x ?p ?y }",
    "SELECT ?z { ?x ?p ?y }",
    "SELECT ?x { ?x ?p ?y",
    "SELECT ?x { ?x ?p }",
    "SELECT { ?x ?p ?y }",
    "SELECT ?x { ?x ?p ?y FILTER(?x < ?y) }",
    'SELECT ?x { ?x "p" ?y }',
    "SELECT ?x { ?x ?p ?y } junk ~",
])
def test_refused(text):
    with pytest.raises(SparqlError):
        parse(text)


@pytest.fixture(scope="module")
def engine(spark):
    triples = spark.createDataFrame(
        [(1, 50, 7), (2, 50, 7), (3, 50, 8), (1, 51, 2), (2, 51, 2), (1, 0, 60), (4, 50, 9)], "s long, p long, o long"
    )
    schema = spark.createDataFrame([(60, 5, 61), (52, 4, 51)], "s long, p long, o long")
    dictionary = spark.createDataFrame(
        [(50, "<http://x/name>"), (50, "<http://x/name>"), (51, "<http://x/knows>"), (60, "<http://x/A>"), (61, "<http://x/B>"),
         (7, '"N"'), (8, '"N"@en'), (9, '"N"'), (7, None), (None, "<http://x/none>")], "id long, text string",
    )
    return Engine(triples, schema, dictionary=dictionary)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_answers(engine):
    p = "PREFIX x: <http://x/> "
    assert rows(engine.sparql(p + "SELECT ?a { ?a a x:B }")) == [(1,)]
    assert rows(engine.sparql(p + "SELECT ?a { ?a a x:B }", reason=False)) == []
    # one text with two ids
    assert rows(engine.sparql(p + 'SELECT ?a { ?a x:name "N" }')) == [(1,), (2,), (4,)]
    assert rows(engine.sparql(p + 'SELECT ?a { ?a x:name "N" }', lexical=True)) == [(1,), (2,), (3,), (4,)]
    assert rows(engine.sparql(p + 'SELECT ?a { ?a x:name "M" }')) == []
    assert rows(engine.sparql(p + "SELECT ?a ?b { ?a x:knows ?b . FILTER(?a != ?b) }")) == [(1, 2)]
    assert rows(engine.sparql(p + "SELECT ?a { ?a x:knows ?a }")) == [(2,)]
    # projection keeps repeated rows, DISTINCT does not
    assert rows(engine.sparql(p + "SELECT ?b { ?a x:knows ?b }")) == [(2,), (2,)]
    assert rows(engine.sparql(p + "SELECT DISTINCT ?b { ?a x:knows ?b }")) == [(2,)]
    assert engine.sparql(p + "SELECT ?b { ?a x:knows ?b }", select_all=True).columns == ["a", "b"]
    assert engine.sparql(p + "SELECT ?a { ?a x:name ?n } LIMIT 2").count() == 2
    assert [r["line"] for r in engine.answer_lines(engine.sparql(p + "SELECT ?a ?b { ?a x:knows ?b FILTER(?a != ?b) }")).collect()] == ["1 2"]


def test_command_line(engine, spark, tmp_path, capsys):
    from loomgraph.__main__ import main

    for name, df in (("t", engine.triples), ("s", engine.schema), ("d", engine.dictionary)):
        df.write.parquet(f"{tmp_path}/{name}")
    query = tmp_path / "q"
    query.write_text("SELECT ?a { ?a a <http://x/B> }")
    common = ["--triples", f"{tmp_path}/t", "--schema", f"{tmp_path}/s", "--dictionary", f"{tmp_path}/d"]
    main([*common, "--sparql", str(query)])
    assert capsys.readouterr().out.splitlines()[1:] == ["Triples = 1", "1"]
    main([*common, "--pattern", "-1 0 61", "--exclude-explicit", "--rules", "rdfs"])
    assert capsys.readouterr().out.splitlines()[1:] == ["Triples = 1", "1 0 61"]
    main([*common, "--closure", "--n-results", "1"])
    assert len(capsys.readouterr().out.splitlines()) == 3


def test_the_vocabulary_needs_no_dictionary(spark):
    e = Engine(spark.createDataFrame([(1, 0, 207), (2, 5, 3)], "s long, p long, o long"))
    assert [tuple(r) for r in e.sparql("SELECT ?x ?c { ?x a ?c }", reason=False).collect()] == [(1, 207)]


@pytest.mark.parametrize("texts", [
    [(101, '"a literal"'), (117, "<http://x/p>")],
    [(101, "<http://x/q>"), (103, "<http://x/q>"), (117, '"of \\"two\\"'), (117, '"of \\"two\\" ids"@en'), (118, '"of \\"two\\"'), (117, None)],
    [(117, "?no <term> at all"), (118, "?no <term> at all"), (None, "?no <term> at all")],
    [(117, RDF_TYPE)],
    [(101, "<http://x/q>"), (117, None)],
])
def test_any_text_of_the_dictionary_is_a_constant(spark, tmp_path, texts):
    from loomgraph.graph_queries import SQL, sparql_store
    from tests.conftest import compare

    data = [(1, 101, 2), (1, 101, 2), (3, 101, 2), (4, 103, 2), (2, 117, 5), (2, 118, 5), (2, 118, 6), (2, 0, 7), (2, 117, None)]
    spark.createDataFrame(data, "s long, p long, o long").coalesce(1).write.parquet(f"{tmp_path}/made/t")
    spark.createDataFrame(texts, "id long, text string").coalesce(1).write.parquet(f"{tmp_path}/made/d")
    (tmp_path / "in").mkdir()
    for made, table in (("t", "triples"), ("d", "dictionary")):
        next((tmp_path / "made" / made).glob("*.parquet")).rename(tmp_path / "in" / f"{table}.parquet")
    got, want = compare(spark, str(tmp_path / "in"), sparql_store, SQL["sparql_store"])
    assert got == want and (got or texts[-1][1] is None)


def test_given_constants(engine):
    query = "SELECT ?a ?n { ?a <urn:p> ?n . FILTER(<urn:p> = <urn:q>) }"
    assert rows(engine.sparql(query, reason=False, constants={"<urn:p>": 51, "<urn:q>": 51})) == [(1, 2), (2, 2)]
    assert rows(engine.sparql(query, reason=False, constants={"<urn:p>": 51, "<urn:q>": 50})) == []
