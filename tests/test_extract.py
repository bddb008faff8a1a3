"""Declarations of Go sources."""

import pytest

from pyspark.sql import functions as F

from patchlens.operators.extract import blocks, extract_elements, numbered_elements, quarantine
from patchlens.plans.queries import QUERIES
from patchlens.sources.tree import read_go_tree, read_tree

CART = '''// Package text.
package shop

import (
	"fmt"
	str "strings"
	// "not/this"
	"net/http"
)

// MaxItems is a limit.
const MaxItems = 10

// Kinds.
const (
	KindA Kind = iota // first
	// a comment of one name only
	KindB, KindC = 4, 5
)

var url = "http://x/y" // trailing

var (
	a, b int
	fn   = func(x int) int {
		return x
	}
	sum = 1 +
		2
)

/*
Cart holds things.

func fake() {}
*/
type Cart struct {
	Items []string // items { here
}

type (
	Reader interface {
		Read(p []byte) (int, error)
	}
	IDs   []int64
	Table map[string]int
	Done  chan struct{}
	Pair[K comparable, V any] struct {
		Key K
	}
	Alias = Cart
)

// Add puts an item in.
//
// It fails when full.
//go:noinline
func (c *Cart) Add(item string, n, m int) (ok bool, err error) {
	s := `raw {
func inner() {
}
`
	return true, fmt.Errorf("}", s)
}

func (Cart) Len() int { return 0 }

func Link() string { return "http://x" } // end

func Map[T, U any](in []T, f func(T) U) []U {
	return nil
}

func multi(
	a, b string,
	opts ...func(*Cart),
) (map[string]int, error) {
	return nil, nil
}

func inline(x interface{}, y struct{ A int }) {
}

func literal(x struct {
	A int
}) error {
	return nil
}

func asm(x int) int

func named() (n, k int) { return }
'''


def frame(spark, *files):
    return spark.createDataFrame([("f", path, content) for path, content in files], "framework string, file_path string, content string")


@pytest.fixture(scope="module")
def cart(spark):
    return {r.name: r for r in extract_elements(frame(spark, ("shop/cart.go", CART))).collect()}


def test_kinds_and_lines(cart):
    got = {n: (r.type, r.line) for n, r in cart.items()}
    line = lambda text: CART[: CART.index(text)].count("\n") + 1
    assert got == {
        "MaxItems": ("const", line("const MaxItems")), "KindA": ("const", line("KindA")), "KindB": ("const", line("KindB")),
        "KindC": ("const", line("KindB")), "url": ("var", line("var url")), "a": ("var", line("a, b int")), "b": ("var", line("a, b int")),
        "fn": ("var", line("fn ")), "sum": ("var", line("sum =")), "Cart": ("struct", line("type Cart")),
        "Reader": ("interface", line("Reader interface")), "IDs": ("type", line("IDs")), "Table": ("type", line("Table")),
        "Done": ("type", line("Done")), "Pair": ("struct", line("Pair[")), "Alias": ("type", line("Alias")),
        "Add": ("method", line("func (c *Cart)")), "Len": ("method", line("func (Cart)")), "Link": ("function", line("func Link")),
        "Map": ("function", line("func Map")), "multi": ("function", line("func multi")), "inline": ("function", line("func inline")),
        "literal": ("function", line("func literal")), "asm": ("function", line("func asm")), "named": ("function", line("func named")),
    }


def test_signatures(cart):
    assert {n: r.signature for n, r in cart.items() if r.signature} == {
        "Cart": "type Cart struct", "Reader": "type Reader interface", "IDs": "type IDs array", "Table": "type Table map",
        "Done": "type Done chan", "Pair": "type Pair struct", "Alias": "type Alias alias",
        "Add": "func (*Cart) Add(item string, n int, m int) (bool, error)", "Len": "func (Cart) Len() int", "Link": "func Link() string",
        "Map": "func Map(in []T, f func(T) U) []U", "multi": "func multi(a string, b string, opts ...func(*Cart)) (map[string]int, error)",
        "inline": "func inline(x interface{}, y struct{ A int })", "literal": "func literal(x struct {\n\tA int\n}) error",
        "asm": "func asm(x int) int", "named": "func named() int",
    }
    assert (cart["Add"].receiver, cart["Len"].receiver, cart["asm"].receiver) == ("*Cart", "Cart", "")


def test_docs_bodies_and_imports(cart):
    assert cart["Add"].doc == "Add puts an item in.\n\nIt fails when full.\n"
    assert cart["Cart"].doc == "Cart holds things.\n\nfunc fake() {}\n"
    assert cart["KindB"].doc == "Kinds.\n" and cart["url"].doc == ""
    assert cart["KindC"].body == "KindB, KindC = 4, 5" and cart["KindA"].body == "KindA Kind = iota"
    assert cart["url"].body == 'url = "http://x/y"' and cart["sum"].body == "sum = 1 +\n\t\t2"
    assert cart["Link"].body == 'func Link() string { return "http://x" }'
    assert cart["Add"].body == CART[CART.index("func (c *Cart)") : CART.index("func (Cart)")].strip()
    assert cart["Cart"].body == "Cart struct {\n\tItems []string // items { here\n}"
    assert {tuple(r.imports) for r in cart.values()} == {("fmt", "strings", "net/http")}
    assert {r.package for r in cart.values()} == {"shop"}


def test_quarantine(spark):
    files = frame(
        spark, ("bad.go", "package x\nfunc broken( {\n"), ("none.go", "hello\n"), ("open.go", 'package x\nvar s = "abc\n'),
        ("stray.go", "package x\nhello there\n"), ("empty.go", "package x\n"), ("good.go", "package x\n\nfunc F() {\nout:\n}\n"),
    )
    assert {r.file_path: r.reason for r in quarantine(files).collect()} == {
        "bad.go": "unbalanced brackets", "none.go": "no package clause", "open.go": "open string or comment",
        "stray.go": "text outside declarations",
    }
    assert [r.name for r in extract_elements(files).collect()] == ["F"]


def test_tree(spark, tmp_path):
    for path in ("main.go", "pkg/helper.go", "pkg/helper_test.go", "vendor/somelib/lib.go", "sub/testdata/t.go", "a b+c/x.go", "notes.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(f"package p\n\nfunc F{len(path)}() {{\n}}\n")
    assert {r.file_path for r in read_tree(spark, str(tmp_path), "f").collect()} >= {"vendor/somelib/lib.go", "pkg/helper_test.go"}
    files = read_go_tree(spark, str(tmp_path), "f")
    assert {r.file_path for r in files.collect()} == {"main.go", "pkg/helper.go", "a b+c/x.go"}
    ids = numbered_elements(extract_elements(files)).orderBy("element_id").collect()
    assert [r.file_path for r in ids] == sorted(r.file_path for r in ids) and len({r.element_id for r in ids}) == 3


def test_extraction_does_not_shuffle(spark):
    plan = extract_elements(frame(spark, ("a.go", CART)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_blocks(spark):
    df = spark.createDataFrame([(1, "head\nA\nx\nB\n"), (2, "A"), (3, "x\ny"), (4, "")], "id int, t string")
    rows = blocks(df, ["id"], "t", start="(?md)^(?=[A-Z])").orderBy("id", "block_no").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 2, 2, "A\nx"), (1, 2, 4, 1, "B"), (2, 1, 1, 1, "A")]


@pytest.mark.parametrize("name", ["extract_elements", "quarantined_files"])
def test_files_of_one_split_are_dealt(spark, sf_dir, name):
    """The table of parts is one split; the work on its files is not one task's."""
    assert len({r.p for r in QUERIES[name](spark, sf_dir).select(F.spark_partition_id().alias("p")).collect()}) > 1
