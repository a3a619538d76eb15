"""Terms, the reserved vocabulary and dictionary coding.

A term is a signed 64-bit id.  Ids of resources and literals are 0 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The ids of the reserved vocabulary.
TYPE = 0
PROPERTY = 1
RANGE = 2
DOMAIN = 3
SUB_PROPERTY_OF = 4
SUB_CLASS_OF = 5
OWL_CLASS = 6
FUNCTIONAL = 7
INVERSE_FUNCTIONAL = 8
SYMMETRIC = 9
TRANSITIVE = 10
SAME_AS = 11
INVERSE_OF = 12
EQUIVALENT_CLASS = 13
EQUIVALENT_PROPERTY = 14
HAS_VALUE = 15
ON_PROPERTY = 16
SOME_VALUES_FROM = 17
ALL_VALUES_FROM = 18
MEMBER = 19
LITERAL = 20
CONTAINER_MEMBERSHIP = 21
DATATYPE = 22
RDFS_CLASS = 23
RESOURCE = 24
REST = 25
FIRST = 26
LIST = 27
NIL = 28
PROPERTY_CHAIN = 29
HAS_KEY = 30
INTERSECTION_OF = 31
UNION_OF = 32
ONE_OF = 33
THING = 34
LITERAL_ONE = 35
MAX_CARDINALITY = 36
MAX_QUALIFIED = 37
ON_CLASS = 38
NOTHING = 39
DATATYPE_PROPERTY = 40
OBJECT_PROPERTY = 41

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"

#: Text of every reserved id, in the order of the ids.
VOCABULARY = [
    f"<{RDF}type>", f"<{RDF}Property>", f"<{RDFS}range>", f"<{RDFS}domain>", f"<{RDFS}subPropertyOf>",
    f"<{RDFS}subClassOf>", f"<{OWL}Class>", f"<{OWL}FunctionalProperty>", f"<{OWL}InverseFunctionalProperty>",
    f"<{OWL}SymmetricProperty>", f"<{OWL}TransitiveProperty>", f"<{OWL}sameAs>", f"<{OWL}inverseOf>",
    f"<{OWL}equivalentClass>", f"<{OWL}equivalentProperty>", f"<{OWL}hasValue>", f"<{OWL}onProperty>",
    f"<{OWL}someValuesFrom>", f"<{OWL}allValuesFrom>", f"<{RDFS}member>", f"<{RDFS}Literal>",
    f"<{RDFS}ContainerMembershipProperty>", f"<{RDFS}Datatype>", f"<{RDFS}Class>", f"<{RDFS}Resource>",
    f"<{RDF}rest>", f"<{RDF}first>", f"<{RDF}List>", f"<{RDF}nil>", f"<{OWL}propertyChainAxiom>",
    f"<{OWL}hasKey>", f"<{OWL}intersectionOf>", f"<{OWL}unionOf>", f"<{OWL}oneOf>", f"<{OWL}Thing>",
    f'"1"^^<{XSD}nonNegativeInteger>', f"<{OWL}maxCardinality>", f"<{OWL}maxQualifiedCardinality>",
    f"<{OWL}onClass>", f"<{OWL}Nothing>", f"<{OWL}DatatypeProperty>", f"<{OWL}ObjectProperty>",
]
RESERVED = {text: i for i, text in enumerate(VOCABULARY)}

#: Predicates whose triples are schema, and the classes whose instances are.
SCHEMA_PREDICATES = [2, 3, 4, 5, 12, 13, 14, 15, 16, 17, 18, 25, 26, 29, 30, 31, 32, 33, 36, 37, 38]
SCHEMA_CLASSES = [1, 6, 7, 8, 9, 10, 23, 40, 41]

#: The named subsets of the schema: (predicate, object) with None for any.
SUBSETS = {
    "rdfs-subproperties": (4, None),
    "rdfs-subclasses": (5, None),
    "rdfs-domain": (3, None),
    "rdfs-range": (2, None),
    "owl-inverse": (12, None),
    "owl-transitive-properties": (0, 10),
    "owl-symmetric-properties": (0, 9),
    "owl-on-properties": (16, None),
    "owl-some-values-from": (17, None),
    "owl-all-values-from": (18, None),
    "owl-has-value": (15, None),
    "owl-functional-properties": (0, 7),
    "owl-inverse-functional-properties": (0, 8),
    "owl-equivalence-classes": (13, None),
    "owl-equivalence-properties": (14, None),
    "owl-type-class": (0, 6),
    "owl-datatype-prop": (0, 40),
    "owl-objtype-prop": (0, 41),
    "owl-same-as": (11, None),
    "owl2-props-axioms": (29, None),
    "owl2-has-key": (30, None),
    "owl2-intersection-of": (31, None),
    "owl2-union-of": (32, None),
    "owl2-one-of": (33, None),
    "owl2-max-card": (36, None),
    "owl2-max-q-card": (37, None),
    "owl2-on-class": (38, None),
}


def clean_dictionary(dictionary: DataFrame) -> DataFrame:
    """``(id, text)`` once for every id: of repeated ids the smallest non-null text."""
    return dictionary.where("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))


def lookup(dictionary: DataFrame | None, texts: list[str], lexical: bool = False, reserved: bool = True) -> dict[str, list[int]]:
    """The ids of a query's constants, reserved ones first; unknown texts are absent.

    Reserved ones need no dictionary; without ``reserved`` it alone counts.

    ``lexical`` also matches a literal whatever its language tag or datatype.
    """
    out = {t: [RESERVED[t]] for t in texts if reserved and t in RESERVED}
    rest = [t for t in texts if t not in out]
    if rest and dictionary is not None:
        text = F.col("text")
        key = F.regexp_replace(text, r'(?s)\A("(?:[^"\\]|\\.)*+").*\z', "$1") if lexical else text
        rows = dictionary.where("id IS NOT NULL").select("id", key.alias("text")).where(F.col("text").isin(rest))
        for r in rows.distinct().collect():
            out.setdefault(r["text"], []).append(r["id"])
    return {t: sorted(ids) for t, ids in out.items()}


def decode(df: DataFrame, dictionary: DataFrame, columns: list[str], tail: int | None = None) -> DataFrame:
    """The columns' ids replaced by their texts, null where the dictionary has none.

    ``tail`` keeps only so many characters from the end.
    """
    d = clean_dictionary(dictionary)
    for c in columns:
        text = F.col("text") if tail is None else F.expr(f"right(text, {int(tail)})")
        df = df.join(d.select(F.col("id").alias(c), text.alias(f"{c}__text")), c, "left").drop(c)
        df = df.withColumnRenamed(f"{c}__text", c)
    return df
