import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.plans.patterns import compile_pattern, line_pattern, pieces, segment_regex


def values(pattern, text, bound=None):
    hit = compile_pattern(pattern).match(text, bound)
    return None if hit is None else {n: v for n, (v, *_) in hit.items()}


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        ("$ORG/$REPO", "acme/frontend", {"ORG": "acme", "REPO": "frontend"}),
        ("$ORG/$REPO", "noslash", None),
        ("$BRANCH", "feature/foo", None),
        ("$$$BRANCH", "feature/foo/bar", {"BRANCH": "feature/foo/bar"}),
        ("support/$MAJOR.$MINOR.$PATCH", "support/1.2.3", {"MAJOR": "1", "MINOR": "2", "PATCH": "3"}),
        ("release/$$$REST", "release/1.2.3/hotfix", {"REST": "1.2.3/hotfix"}),
        ("$_/$NAME", "a/b", {"NAME": "b"}),
        ("$$$_/end", "/end", {}),
        ("use${ENTITY}Query", "useUserQuery", {"ENTITY": "User"}),
        ("use${ENTITY}Query", "useUserMutation", None),
        ("$PROTO://$HOST:$PORT", "https://api.example.com:8443", {"PROTO": "https", "HOST": "api.example.com", "PORT": "8443"}),
        ("$A-$A", "x-x", {"A": "x"}),
        ("$A-$A", "x-y", None),
        ("**/*.json", "bar.json", {}),
        ("**/*.json", "foo/bar.json", {}),
        ("Cargo.toml", "crates/config/Cargo.toml", None),
        ("**/Cargo.toml", "Cargo.toml", {}),
        ("**/Cargo.toml", "crates/config/Cargo.toml", {}),
        ("main|release/*", "release/v3", {}),
        ("*.{ts,tsx}", "a/b.tsx", {}),
        ("re:^v(?P<MAJOR>\\d+)", "v12.3", {"MAJOR": "12"}),
    ],
)
def test_golden(pattern, text, want):
    assert values(pattern, text) == want


def test_offsets_and_bound_names():
    assert compile_pattern("use${ENTITY}Query").match("useUserQuery")["ENTITY"][1:] == (3, 7)
    assert values("$NAME:$TAG", "nginx:latest", {"NAME": "nginx"}) == {"TAG": "latest"}
    assert values("$NAME:$TAG", "nginx:latest", {"NAME": "apache"}) is None


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        ("FROM $IMAGE AS $STAGE", "FROM node:20-alpine AS builder", {"IMAGE": "node:20-alpine", "STAGE": "builder"}),
        ("FROM $IMAGE:$TAG", "FROM node:20-alpine AS builder", {"IMAGE": "node", "TAG": "20-alpine AS builder"}),
        (r"re:FROM\s+$IMAGE:$TAG", "FROM node:20-alpine AS builder", {"IMAGE": "node", "TAG": "20-alpine"}),
        ("COPY $$$SRC $DEST", "COPY . .", {"SRC": ".", "DEST": "."}),
        ("COPY $$$SRC $DEST", "COPY a/b ./", None),
        (r"re:\t$MODULE $VERSION", "\tgithub.com/gin v1.9.1", {"MODULE": "github.com/gin", "VERSION": "v1.9.1"}),
        ("$PACKAGE==$VERSION", "celery[redis]==5.3", {"PACKAGE": "celery[redis]", "VERSION": "5.3"}),
    ],
)
def test_lines(pattern, text, want):
    hit = line_pattern(pattern).match(text)
    assert (None if hit is None else {n: v for n, (v, *_) in hit.items()}) == want


def model(parts, text, caps):
    """Depth-first matching, shortest first, as the rules of segments say."""
    if not parts:
        return caps if not text else None
    (kind, of), rest = parts[0], parts[1:]
    if kind == "lit":
        return model(rest, text[len(of) :], caps) if text.startswith(of) else None
    if of in caps:
        return model(rest, text[len(caps[of]) :], caps) if text.startswith(caps[of]) else None
    following = next((t for k, t in rest if k == "lit"), None)
    for n in range(0 if kind == "many" else 1, len(text) + 1):
        value = text[:n]
        if kind == "one" and "/" in value:
            return None
        if kind == "one" and of != "_" and following is not None and not text[n:].startswith(following):
            continue
        found = model(rest, text[n:], caps if of == "_" else caps | {of: value})
        if found is not None:
            return found
    return None


PIECE = st.sampled_from(["$A", "$B", "$$$C", "$_", "$$$_", "/", "-", "x", "ab", "."])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECE, min_size=1, max_size=5), st.text("abx/-.", max_size=8))
def test_segments_equal_the_model(parts, text):
    # A sign between neighbours keeps names apart.
    pattern = "".join(p + ("{" if False else "") for p in parts)
    regex, names = segment_regex(pattern)
    m = re.match(regex, text)
    got = None if m is None else {n: m[i + 1] for i, n in enumerate(names)}
    assert got == model(pieces(pattern), text, {})


def test_names_bound_by_a_column(spark):
    from pyspark.sql import functions as F

    rows = [("a.b", "a.b/x"), ("a.b", "aXb/x"), ("q\\Ez", "q\\Ez/y"), ("$1", "$1/z"), (None, "n/z"), ("(", None)]
    df = spark.createDataFrame(rows, "known string, text string")
    hit, found = compile_pattern("$REPO/$NAME").bound(F.col("text"), {"REPO": F.col("known")})
    assert list(found) == ["NAME"]
    assert [r[0] for r in df.select(F.when(hit, found["NAME"])).collect()] == ["x", None, "y", "z", None, None]
