"""Declarations of seven languages: split over lines, nested, wrapped and grouped."""

import pytest

from codeloom.sources import declarations, extractors

PHP = r"""<?php
namespace App\Http;

use App\Models\User;
use App\Models\{Post, Comment as C};

// class InComment {}
const LIMIT = 10, OTHER = 'class X {';
function &helper(array $x) { return fn() => new class { }; }
abstract class Users
    extends Base
    implements Jsonable, Countable
{
    use SoftDeletes, Loggable;
    public const int MAX = 5;
    #[Route("/x")]
    public static function
        index(int $a, callable $f): array
    {
        $g = function () use ($a) { if ($a) { return helper($a); } };
        return User::all();
    }
    abstract protected function show();
}
interface Loggable { public function log(string $x): void; }
trait Caches { private function key() { return "}"; } }
enum Status: string { case On = 'on'; const DEF = self::On; }
"""
C = r"""
#include <stdio.h>
#define MAX_BUFFER 10
#define WRAP(x) (x)
# define VERSION \
   "1 {"
typedef unsigned long ulong;
typedef struct point { int x; } point_t;
typedef int (*handler)(int);
struct config {
    struct config *next;
    int (*run)(void);
};
enum level { LOW, HIGH };
static const char *
get_name(struct config *c)
{
    if (c) { return "x{"; }
    return 0;
}
int add(int a, int b) { return a + b; }
int declared(int a);
PHP_FUNCTION(parse_url)
{
    add(1, 2);
}
int table[] = { 1, 2 };
struct config global = { 0 };
"""
CPP = r"""
#define LIMIT 3
namespace app { namespace net {
class Base;
template <typename T,
          typename U>
class Buffer
    : public Base, private ns::Other<T>
{
public:
    explicit Buffer(int n);
    Buffer() = default;
    ~Buffer() { clear(); }
    void push(const T &x) { items_.push_back(x); }
    virtual T pop() const;
    Buffer &operator=(const Buffer &o);
    bool operator()(int x) const { return x; }
    using value = T;
    struct Node { int v; };
private:
    int size_ = 0;
};
struct Endpoint final { int port; };
union Tag { int a; float b; };
enum class State : int { Up, Down };
typedef unsigned long ulong;
using Bytes = Buffer<char, int>;
template <typename T> concept Hashable = requires(T t) { t.hash(); };
int free_function(int a) { auto f = [&](int b) { return a + b; }; return f(1); }
Connection::Connection(int fd) : fd_(fd), next_{nullptr} { open(); }
Connection::~Connection() {}
void
Connection::open()
{
    for (;;) { break; }
}
}}
namespace a::b {
template <typename T, typename U>
T app::Buffer<T, U>::take() { return T{}; }
}
"""
RUST = r"""
use std::fmt;
pub type Result<T> = std::result::Result<T, Error>;
pub const MAX: usize = 10;
static mut GLOBAL: &str = "fn x() {";
#[derive(Debug)]
pub struct Config<'a> { name: &'a str }
pub struct Unit;
struct Pair(i32, char);
pub(crate) enum Level { A, B { x: i32 } }
pub trait Draw { const N: i32; fn draw(&self); fn twice(&self) { self.draw() } }
impl<'a> Config<'a> {
    pub const fn new(c: char) -> Self { if c == '{' { loop {} } Config { name: r#"a"}"# } }
    pub async fn
        run<T>(&self) -> T
    where T: Clone
    { todo!() }
}
impl fmt::Display for Pair { fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result { write!(f, "}}") } }
mod utils { pub fn help() { inner::go(); } mod inner; }
macro_rules! log_msg { ($x:expr) => { println!($x) }; }
unsafe extern "C" fn raw(p: *const u8) {}
"""
TS = r"""
import { x } from './m'
export interface Named { name: string; greet(a: number): void }
export type Role = 'a' | 'b' | { kind: string }
export const enum Status { On = 1 }
export const TIMEOUT = 5, names: Map<string, number> = new Map()
const { a, b } = load()
let handler = async (q: string) => {
  const local = 1
  return { go() { return 1 } }
}
export default abstract class Service<T extends Named> extends Base<T> implements Named {
  private items: T[] = []
  constructor(private readonly db: Db) { super() }
  public async findAll(opts: { deep: boolean } = { deep: true }): Promise<T[]> {
    if (opts.deep) { return this.items.filter((x) => { return x }) }
    return `}` as any
  }
  static get size() { return 1 }
  delete(id: number): void { }
}
export function make(
  a: number,
): Service<any> { return new Service(a) }
function* steps() { yield 1 }
"""
JS = r"""
const express = require('express')
var old = 1
export const PORT = 3000
exports.thing = function () { return 1 }
async function start() {
  const app = express()
  app.get('/', function (req, res) { const inner = 1; res.send('}') })
}
class Router extends Base {
  constructor() { super(); this.x = { get() { return 1 } } }
  get(path) { return path }
  static async post(path) { while (true) { break } }
}
"""
GO = r"""
package main
import (
	"fmt"
	m "math"
)
const MaxRetries = 3
const (
	DefaultPort = 80
	DefaultHost, Other = "h", `{`
	Next
)
type Config struct {
	Name string
	run func() error
}
type (
	Handler interface { Handle(x int) error }
	Alias = Config
)
type Duration int64
func NewConfig(a int,
	b string) (*Config, error) {
	const local = 1
	type inner struct{}
	f := func() { fmt.Println("}") }
	f()
	return &Config{Name: b}, nil
}
func (c *Config) String() string { return c.Name }
func (s Server[T]) Start() {}
func (Config) Anon() {}
"""
WANT = {
    "php": (PHP, {
        (r"App\Http\LIMIT", "constant"), (r"App\Http\OTHER", "constant"), (r"App\Http\helper", "function"), (r"App\Http\Users", "class"), (r"App\Http\Users\MAX", "constant"), (r"App\Http\Users\index", "method"), (r"App\Http\Users\show", "method"),
        (r"App\Http\Loggable", "interface"), (r"App\Http\Loggable\log", "method"), (r"App\Http\Caches", "trait"), (r"App\Http\Caches\key", "method"), (r"App\Http\Status", "enum"), (r"App\Http\Status\DEF", "constant"),
    }),
    "c": (C, {("MAX_BUFFER", "macro"), ("VERSION", "macro"), ("ulong", "constant"), ("point", "struct"), ("point_t", "constant"), ("config", "struct"), ("level", "enum"), ("get_name", "function"), ("add", "function"), ("parse_url", "function")}),
    "cpp": (CPP, {
        ("LIMIT", "macro"), ("app::net::Buffer", "class"), ("app::net::Buffer::Buffer", "method"), ("app::net::Buffer::~Buffer", "method"), ("app::net::Buffer::push", "method"), ("app::net::Buffer::pop", "method"),
        ("app::net::Buffer::operator=", "method"), ("app::net::Buffer::operator()", "method"), ("app::net::Buffer::value", "constant"), ("app::net::Node", "struct"), ("app::net::Endpoint", "struct"), ("app::net::Tag", "struct"), ("app::net::State", "enum"),
        ("app::net::ulong", "constant"), ("app::net::Bytes", "constant"), ("app::net::Hashable", "constant"), ("app::net::free_function", "function"), ("app::net::Connection::Connection", "method"), ("app::net::Connection::~Connection", "method"),
        ("app::net::Connection::open", "method"), ("a::b::app::Buffer<T,U>::take", "method"),
    }),
    "rust": (RUST, {
        ("Result", "constant"), ("MAX", "constant"), ("GLOBAL", "constant"), ("Config", "struct"), ("Unit", "struct"), ("Pair", "struct"), ("Level", "enum"), ("Draw", "trait"), ("N", "constant"), ("twice", "function"), ("Config<'a>::new", "method"), ("Config<'a>::run", "method"),
        ("Pair::fmt", "method"), ("utils", "module"), ("help", "function"), ("inner", "module"), ("log_msg", "macro"), ("raw", "function"),
    }),
    "typescript": (TS, {
        ("Named", "interface"), ("Role", "constant"), ("Status", "enum"), ("TIMEOUT", "constant"), ("names", "constant"), ("handler", "constant"), ("Service", "class"), ("Service.constructor", "method"), ("Service.findAll", "method"), ("Service.size", "method"),
        ("Service.delete", "method"), ("make", "function"), ("steps", "function"), ("go", "method"),
    }),
    "javascript": (JS, {("express", "constant"), ("PORT", "constant"), ("thing", "constant"), ("start", "function"), ("Router", "class"), ("Router.constructor", "method"), ("Router.get", "method"), ("Router.post", "method")}),
    "go": (GO, {
        ("MaxRetries", "constant"), ("DefaultPort", "constant"), ("DefaultHost", "constant"), ("Other", "constant"), ("Next", "constant"), ("Config", "struct"), ("Handler", "interface"), ("Alias", "constant"), ("Duration", "constant"), ("NewConfig", "function"), ("Config.String", "method"),
        ("Server.Start", "method"), ("Config.Anon", "method"),
    }),
}


@pytest.mark.parametrize("lang", sorted(WANT))
def test_declarations(lang):
    text, want = WANT[lang]
    got = declarations.symbols_of("f", lang, text)
    assert {(s[1], s[2]) for s in got} == want
    lines = text.split("\n")
    for name, _, _, _, a, b, c, d in got:
        assert 1 <= a <= b <= len(lines) and (a, c) <= (b, d)
        bare = name.removeprefix("~").removeprefix("operator").strip("()=") or "operator"
        assert any(bare in line for line in lines[a - 1 : b]), name


def test_spans_reach_from_the_first_word_to_the_closing_brace():
    at = {s[0]: s[4:6] for s in declarations.symbols_of("f", "c", C)}
    lines = C.split("\n")
    assert lines[at["get_name"][0] - 1].startswith("static") and lines[at["get_name"][1] - 1] == "}" and at["get_name"][1] - at["get_name"][0] == 5
    at = {s[1]: s[4:6] for s in declarations.symbols_of("f", "php", PHP)}
    lines = PHP.split("\n")
    assert lines[at[r"App\Http\Users"][0] - 1].startswith("abstract class") and lines[at[r"App\Http\Users"][1] - 1] == "}"


@pytest.mark.parametrize("text", ["", "}", "}}}{{{", "class", "class {", "fn (", "((((", "/* open", '"open', "const", "struct ;", "namespace", "type", "func (", "#define", "typedef", "operator", "~", "template <", "impl", "using", "\\", "é ü 世界 {}"])
def test_broken_texts_are_survived(text):
    for lang in declarations.PATTERNS:
        for s in declarations.symbols_of("f", lang, text):
            assert s[4] <= s[5]


def test_long_texts_are_linear():
    import time

    for lang, piece in (("rust", "fn a() { b(); }\n"), ("javascript", "x = { a: [1, 2], b: { c: 3 } }\n"), ("c", "int f(int a) { return (a); }\n"), ("go", "var x = 1\n"), ("php", "$a = [1, 'x' => ['y']];\n")):
        began = time.process_time()
        declarations.symbols_of("f", lang, piece * 20_000)
        assert time.process_time() - began < 15, lang


def test_uses():
    refs = lambda lang, text: {(r[2], r[4]) for r in extractors.references_of("f", lang, text)}
    php = refs("php", PHP)
    assert {("SoftDeletes", "trait_use"), ("Loggable", "trait_use"), ("App\\Models\\User", "import"), ("App\\Models\\Post", "import"), ("App\\Models\\Comment", "import"), ("Base", "inheritance"), ("Jsonable", "inheritance"), ("Countable", "inheritance")} <= php
    assert ("SoftDeletes", "import") not in php
    assert {("todo", "call"), ("write", "call"), ("inner::go", "call")} <= refs("rust", RUST)
    assert {("Base", "inheritance"), ("ns::Other", "inheritance")} <= refs("cpp", CPP) and ("std::vector", "import") in refs("cpp", "using std::vector;\nusing namespace std;\nusing A = B;\n")
    assert {("fmt", "import"), ("math", "import")} <= refs("go", GO)
