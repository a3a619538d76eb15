"""Rules: model, text format, and the built-in profiles."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from loomgraph import terms as T

Term = int | str  # an id, or a variable written ?name


@dataclass(frozen=True)
class Atom:
    s: Term
    p: Term
    o: Term
    symmetric: bool = False  # also read with s and o swapped

    def terms(self) -> tuple[Term, Term, Term]:
        return self.s, self.p, self.o

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t for t in self.terms() if is_variable(t)))

    def replaced(self, values: dict[str, Term]) -> Atom:
        return Atom(*(values.get(t, t) if is_variable(t) else t for t in self.terms()), self.symmetric)


def is_variable(t: object) -> bool:
    return isinstance(t, str)


@dataclass(frozen=True)
class Rule:
    """``head`` holds where ``schema`` holds in the T-box and ``body`` in all triples.

    ``elements`` names the variable of a schema atom that is an RDF list.  In a
    rule on lists a variable ``?el_n`` is the n-th element; an atom with ``_n``
    in a name is repeated for every position, ``_n+1`` being the next and, in
    the head, the last; a bare use of the list's variable stands for each
    element by itself.
    """

    name: str
    head: Atom
    schema: tuple[Atom, ...] = ()
    body: tuple[Atom, ...] = ()
    elements: str | None = None

    @property
    def kind(self) -> int:
        if self.elements:
            return 4
        return min(len(self.body), 2) + 1

    def each(self) -> bool:
        """A list rule about single elements rather than whole lists."""
        return self.elements is not None and (
            self.elements in self.head.terms() or any(self.elements in a.terms() for a in self.body)
        )


def check(rule: Rule) -> None:
    """Every head variable must be bound, so that rules make no new terms."""
    bound = {v for a in (*rule.schema, *rule.body) for v in a.variables()}
    if rule.elements:
        bound |= {"?u_0", "?u_n+1"} & {v for a in rule.body for v in (*a.variables(), "?u_0")}
    for v in rule.head.variables():
        if v not in bound:
            raise ValueError(f"rule {rule.name}: {v} is not bound")


_NAMES = {k: v for k, v in vars(T).items() if isinstance(v, int) and k.isupper()}


def _atom(text: str) -> Atom:
    symmetric = text.endswith("+")
    parts = text.rstrip("+").split()
    if len(parts) != 3:
        raise ValueError(f"not a pattern: {text!r}")
    return Atom(*(p if p.startswith("?") else _NAMES.get(p) if p in _NAMES else int(p) for p in parts), symmetric)


def rule(name: str, text: str) -> Rule:
    """``head <- schema, ... ; body, ...``; a schema part ``list ?l`` makes ?l a list."""
    head, _, rest = text.partition("<-")
    schema, _, body = rest.partition(";")
    parts = [x.strip() for x in schema.split(",") if x.strip()]
    elements = next((x.split()[1] for x in parts if x.startswith("list ")), None)
    out = Rule(
        name,
        _atom(head.strip()),
        tuple(_atom(x) for x in parts if not x.startswith("list ")),
        tuple(_atom(x.strip()) for x in body.split(",") if x.strip()),
        elements,
    )
    check(out)
    return out


_PATTERN = re.compile(r"\(([^)]*)\)(?:@\[([^\]]*)\])?")


def parse_rule_file(text: str) -> list[Rule]:
    """Rules in the line format ``type<TAB>(head) :- (pattern)@[subset],...@@(pattern),...``.

    Patterns with a subset are schema, those without are body, and one of a
    single term is the list; ``+`` after a subset's name makes its pattern
    symmetric, ``*`` changes nothing as constants are always enforced.
    """
    out = []
    for no, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        kind, _, body = line.strip().partition("\t")
        head, arrow, rest = body.partition(":-")
        if not kind.isdigit() or kind not in "1234" or not arrow:
            raise ValueError(f"line {no}: not a rule")
        schema, generic, elements = [], [], None
        for terms, subset in _PATTERN.findall(rest):
            if len(terms.split()) == 1:
                elements = terms.strip()
            elif subset:
                schema.append(_atom(terms + ("+" if subset.endswith("+") else "")))
            else:
                generic.append(_atom(terms))
        found = _PATTERN.search(head)
        if not found:
            raise ValueError(f"line {no}: no head")
        r = Rule(f"line-{no}", _atom(found[1]), tuple(schema), tuple(generic), elements)
        check(r)
        if r.kind != int(kind):
            raise ValueError(f"line {no}: type {kind} does not fit its patterns")
        out.append(r)
    return out


@dataclass
class Profile:
    name: str
    rules: list[Rule] = field(default_factory=list)

    def only(self, *names: str) -> Profile:
        return Profile(self.name, [r for r in self.rules if r.name in names])


# OWL 2 RL rules by their names in the W3C profile; see the profile for their meaning.
_OWL = {
    "prp-trp": "?a ?p ?c <- ?p TYPE TRANSITIVE ; ?a ?p ?b, ?b ?p ?c",
    "prp-fp": "?y ?same ?z <- ?p TYPE FUNCTIONAL ; ?x ?p ?y, ?x ?p ?z",
    "prp-ifp": "?y ?same ?z <- ?p TYPE INVERSE_FUNCTIONAL ; ?y ?p ?x, ?z ?p ?x",
    "prp-spo1": "?a ?q ?b <- ?p SUB_PROPERTY_OF ?q ; ?a ?p ?b",
    "prp-dom": "?a TYPE ?c <- ?p DOMAIN ?c ; ?a ?p ?b",
    "prp-rng": "?b TYPE ?c <- ?p RANGE ?c ; ?a ?p ?b",
    "prp-eqp": "?a ?q ?b <- ?q EQUIVALENT_PROPERTY ?p+ ; ?a ?p ?b",
    "prp-inv": "?b ?q ?a <- ?q INVERSE_OF ?p+ ; ?a ?p ?b",
    "prp-symp": "?b ?p ?a <- ?p TYPE SYMMETRIC ; ?a ?p ?b",
    "prp-spo2": "?u_0 ?p ?u_n+1 <- ?p PROPERTY_CHAIN ?l, list ?l ; ?u_n ?el_n ?u_n+1",
    "prp-key": "?x ?same ?y <- ?c HAS_KEY ?l, list ?l ; ?x TYPE ?c, ?y TYPE ?c, ?x ?el_n ?z_n, ?y ?el_n ?z_n",
    "cax-sco": "?x TYPE ?d <- ?c SUB_CLASS_OF ?d ; ?x TYPE ?c",
    "cax-eqc": "?x TYPE ?d <- ?d EQUIVALENT_CLASS ?c+ ; ?x TYPE ?c",
    "cls-hv1": "?u ?p ?v <- ?c HAS_VALUE ?v, ?c ON_PROPERTY ?p ; ?u TYPE ?c",
    "cls-hv2": "?u TYPE ?c <- ?c HAS_VALUE ?v, ?c ON_PROPERTY ?p ; ?u ?p ?v",
    "cls-svf1": "?u TYPE ?c <- ?c SOME_VALUES_FROM ?d, ?c ON_PROPERTY ?p ; ?u ?p ?v, ?v TYPE ?d",
    "cls-svf2": "?u TYPE ?c <- ?c SOME_VALUES_FROM THING, ?c ON_PROPERTY ?p ; ?u ?p ?v",
    "cls-avf": "?v TYPE ?d <- ?c ALL_VALUES_FROM ?d, ?c ON_PROPERTY ?p ; ?u ?p ?v, ?u TYPE ?c",
    "cls-maxc2": "?y ?same ?z <- ?c MAX_CARDINALITY LITERAL_ONE, ?c ON_PROPERTY ?p ; ?u TYPE ?c, ?u ?p ?y, ?u ?p ?z",
    "cls-maxqc3": "?y ?same ?z <- ?c MAX_QUALIFIED LITERAL_ONE, ?c ON_PROPERTY ?p, ?c ON_CLASS ?d ; ?u TYPE ?c, ?u ?p ?y, ?y TYPE ?d, ?u ?p ?z, ?z TYPE ?d",
    "cls-maxqc4": "?y ?same ?z <- ?c MAX_QUALIFIED LITERAL_ONE, ?c ON_PROPERTY ?p, ?c ON_CLASS THING ; ?u TYPE ?c, ?u ?p ?y, ?u ?p ?z",
    "cls-uni": "?y TYPE ?c <- ?c UNION_OF ?l, list ?l ; ?y TYPE ?l",
    "cls-oo": "?l TYPE ?c <- ?c ONE_OF ?l, list ?l",
    "cls-int1": "?y TYPE ?c <- ?c INTERSECTION_OF ?l, list ?l ; ?y TYPE ?el_n",
    "cls-int2": "?y TYPE ?l <- ?c INTERSECTION_OF ?l, list ?l ; ?y TYPE ?c",
    "scm-spo": "?a SUB_PROPERTY_OF ?c <- ?a SUB_PROPERTY_OF ?b, ?b SUB_PROPERTY_OF ?c",
    "scm-sco": "?a SUB_CLASS_OF ?c <- ?a SUB_CLASS_OF ?b, ?b SUB_CLASS_OF ?c",
    "scm-op": "?p SUB_PROPERTY_OF ?p <- ?p TYPE OBJECT_PROPERTY",
    "scm-op-eq": "?p EQUIVALENT_PROPERTY ?p <- ?p TYPE OBJECT_PROPERTY",
    "scm-dp": "?p SUB_PROPERTY_OF ?p <- ?p TYPE DATATYPE_PROPERTY",
    "scm-dp-eq": "?p EQUIVALENT_PROPERTY ?p <- ?p TYPE DATATYPE_PROPERTY",
    "scm-cls-thing": "?c SUB_CLASS_OF THING <- ?c TYPE OWL_CLASS",
    "scm-cls-self": "?c SUB_CLASS_OF ?c <- ?c TYPE OWL_CLASS",
    "scm-cls-nothing": "NOTHING SUB_CLASS_OF ?c <- ?c TYPE OWL_CLASS",
    "scm-cls-eq": "?c EQUIVALENT_CLASS ?c <- ?c TYPE OWL_CLASS",
    "scm-eqp1": "?p SUB_PROPERTY_OF ?q <- ?p EQUIVALENT_PROPERTY ?q+",
    "scm-eqp2": "?p EQUIVALENT_PROPERTY ?q <- ?p SUB_PROPERTY_OF ?q, ?q SUB_PROPERTY_OF ?p",
    "scm-eqc1": "?c SUB_CLASS_OF ?d <- ?c EQUIVALENT_CLASS ?d+",
    "scm-eqc2": "?c EQUIVALENT_CLASS ?d <- ?c SUB_CLASS_OF ?d, ?d SUB_CLASS_OF ?c",
    "scm-dom1": "?p DOMAIN ?d <- ?p DOMAIN ?c, ?c SUB_CLASS_OF ?d",
    "scm-dom2": "?p DOMAIN ?c <- ?q DOMAIN ?c, ?p SUB_PROPERTY_OF ?q",
    "scm-rng1": "?p RANGE ?d <- ?p RANGE ?c, ?c SUB_CLASS_OF ?d",
    "scm-rng2": "?p RANGE ?c <- ?q RANGE ?c, ?p SUB_PROPERTY_OF ?q",
    "scm-hv": "?c SUB_CLASS_OF ?d <- ?c HAS_VALUE ?i, ?c ON_PROPERTY ?p, ?d HAS_VALUE ?i, ?d ON_PROPERTY ?q, ?p SUB_PROPERTY_OF ?q",
    "scm-svf1": "?c SUB_CLASS_OF ?d <- ?c SOME_VALUES_FROM ?x, ?c ON_PROPERTY ?p, ?d SOME_VALUES_FROM ?y, ?d ON_PROPERTY ?p, ?x SUB_CLASS_OF ?y",
    "scm-svf2": "?c SUB_CLASS_OF ?d <- ?c SOME_VALUES_FROM ?x, ?c ON_PROPERTY ?p, ?d SOME_VALUES_FROM ?x, ?d ON_PROPERTY ?q, ?p SUB_PROPERTY_OF ?q",
    "scm-avf1": "?c SUB_CLASS_OF ?d <- ?c ALL_VALUES_FROM ?x, ?c ON_PROPERTY ?p, ?d ALL_VALUES_FROM ?y, ?d ON_PROPERTY ?p, ?x SUB_CLASS_OF ?y",
    "scm-avf2": "?d SUB_CLASS_OF ?c <- ?c ALL_VALUES_FROM ?x, ?c ON_PROPERTY ?p, ?d ALL_VALUES_FROM ?x, ?d ON_PROPERTY ?q, ?p SUB_PROPERTY_OF ?q",
    "scm-int": "?c SUB_CLASS_OF ?l <- ?c INTERSECTION_OF ?l, list ?l",
    "scm-uni": "?l SUB_CLASS_OF ?c <- ?c UNION_OF ?l, list ?l",
}

#: Where the common rule file departs from the W3C profile.
_AS_IS = {
    "scm-dom2": "?p DOMAIN ?c <- ?q DOMAIN ?c, ?q SUB_PROPERTY_OF ?p",
    "scm-rng2": "?p RANGE ?c <- ?q RANGE ?c, ?q SUB_PROPERTY_OF ?p",
    "cax-eqc": "?x TYPE ?d <- ?d EQUIVALENT_CLASS ?c+ ; ?x TYPE ?d",
    "scm-svf1": "?c SUB_CLASS_OF ?d <- ?c SOME_VALUES_FROM ?x, ?c ON_PROPERTY ?p, ?d SOME_VALUES_FROM ?x, ?d ON_PROPERTY ?p, ?x SUB_CLASS_OF ?y",
    "scm-avf2": "?c SUB_CLASS_OF ?d <- ?c ALL_VALUES_FROM ?x, ?c ON_PROPERTY ?p, ?d ALL_VALUES_FROM ?x, ?d ON_PROPERTY ?q, ?p SUB_PROPERTY_OF ?q",
}


def _build(name: str, texts: dict[str, str]) -> Profile:
    return Profile(name, [rule(n, t.replace("?same", "SAME_AS")) for n, t in texts.items()])


OWL2RL_SPEC = _build("owl2rl_spec", _OWL)
OWL2RL_ASIS = _build("owl2rl_asis", _OWL | _AS_IS)
RDFS = Profile(
    "rdfs", OWL2RL_SPEC.only("prp-spo1", "cax-sco", "scm-spo", "scm-sco", "scm-eqp2", "scm-eqc2").rules
)
#: What is left to do on instances once the schema is closed: no rule that concludes sameAs.
AFTER_CLOSURE = Profile(
    "after_closure", [r for r in OWL2RL_SPEC.rules if not r.name.startswith("scm-") and r.head.p != T.SAME_AS]
)
PROFILES = {p.name: p for p in (RDFS, OWL2RL_SPEC, OWL2RL_ASIS, AFTER_CLOSURE)}


def unrolled(r: Rule, n: int) -> Rule:
    """A rule on whole lists, for lists of ``n`` elements: variables ``?el_0`` to ``?el_{n-1}``."""

    def at(a: Atom, i: int) -> Atom:
        def name(t: Term) -> Term:
            if not is_variable(t):
                return t
            if t.endswith("_n+1"):
                return f"{t[:-4]}_{i + 1}"
            return f"{t[:-2]}_{i}" if t.endswith("_n") else t

        return Atom(*map(name, a.terms()), a.symmetric)

    def repeats(a: Atom) -> bool:
        return any(is_variable(t) and t.endswith(("_n", "_n+1")) for t in a.terms())

    body = [b for a in r.body if not repeats(a) for b in (a,)]
    for i in range(n):
        body += [at(a, i) for a in r.body if repeats(a)]
    return Rule(f"{r.name}/{n}", at(r.head, n - 1), r.schema, tuple(body))
