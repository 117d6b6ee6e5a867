"""Languages read by lexing: one small file each."""

import pytest
from graphloom import build
from graphloom.sources import lexed, repo

FILES = {
"src/net.rs":'''use crate::util::{help, Other as O};
use std::collections::HashMap;
use super::x;
pub const LIMIT: usize = 3;
pub trait Draw: Base { fn draw(&self) -> i32; }
pub struct Client<T> { a: T }
impl<T> Draw for Client<T> {
    fn draw(&self) -> i32 { if self.a > LIMIT && true { help(1) } else { Vec::new(); 0 } }
}
mod inner { pub fn f() { /* no( */ let s = "x(y)"; g(s); } }
''',
"src/index.ts":'''import { a as b, c } from './util/index';
import React from 'react';
const x = require('../y');
export interface Shape extends Base, Other { area(): number; }
export class Circle<T> extends Round implements Shape, Z {
  private r = 1;
  constructor(r: number) { super(); this.r = r; }
  area(): number { return this.r > 0 ? Math.sqrt(this.r) : helper(this.r); }
}
export const LIMIT = 3;
function helper(n: number): number { for (let i = 0; i < n; i++) { b(i); } return n; }
''',
"core/Engine.kt":'''package core
import pkg.core.Other as O
import kotlin.math.*
interface Run { fun go() }
class Engine(val a: Int) : Base(a), Run {
    companion object { fun make(): Engine { return Engine(1) } }
    override fun go() { if (a > 1) start(a) }
}
fun top(x: Int): Int = helper(x)
val LIMIT = 3
''',
"shapes/circle.c":'''#include "../core/engine.h"
#include <sys/types.h>
#define MAX 3
#define SQ(x) ((x)*(x))
struct point { int x; };
typedef struct point pt;
enum color { RED, GREEN };
static int counter = 0;
int area(int r);
static int area2(struct point *p, int r)
{
    if (r && p) { return area(r); }
    for (;;) { draw(p); }
}
''',
"core/Engine.java":'''package acme.core;
import acme.shapes.Shape;
import static java.lang.Math.max;
import java.util.*;
public class Engine extends Base implements Run, Other {
    private int n = f(2);
    enum Mode { ON, OFF; }
    public Engine(int a) { super(a); }
    @Override
    public List<String> go(int a, String b) throws IOException {
        if (a > 0 || b == null) { return new ArrayList<>(helper.make(a)); }
        return this.other(max(a, 1));
    }
}
interface Run extends X { void go(); }
''',
"shapes/circle.go":'''package shapes
import (
  "fmt"
  m "math"
  "pkg/core"
)
type Shape interface { 
  Base
  Area() float64
}
type Circle struct { r float64 }
func (c *Circle) Area() float64 { if c.r > 0 { return m.Sqrt(c.r) }; return helper(c.r) }
func helper(x float64) float64 { y := x; fmt.Println(y); return y }
const Limit = 3
''',
"lib/util.sh":'''#!/bin/bash
source ./other.sh
LIMIT=3
greet() {
  local n=$1
  if [ "$n" ]; then
    echo hi && run_it "$n"
  fi
}
greet world
''',
"shapes/Circle.cpp":'''#include "Circle.hpp"
using std::vector;
namespace geo {
class Circle : public Shape, private Other {
 public:
  Circle(double r) : r_(r) {}
  double area() const override { return compute(r_); }
 private:
  double r_;
};
double Circle::size(int k) const { if (k) { return helper(k); } return 0; }
int free_fn(int a) { return a > 0 ? other::go(a) : 0; }
}
''',
"Shapes/Circle.swift":'''import Foundation
protocol Shape: Base { func area() -> Double }
class Circle: Round, Shape {
  var r = 1.0
  init(r: Double) { self.r = r }
  func area() -> Double { guard r > 0 else { return 0 }; return compute(r) }
}
extension Circle: Printable { func show() { print(r) } }
enum Mode { case on, off }
let limit = 3
func top(x: Int) -> Int { return helper(x) }
''',
"lib/circle.rb":'''require_relative 'shape'
require 'json'
LIMIT = 3
module Geo
  class Circle < Shape
    def initialize(r)
      @r = r
    end
    def self.make(r)
      new(r) if r
    end
    def area
      if @r
        compute(@r)
      end
    end
  end
end
def top(x)
  helper(x)
end
''',
"lib/shapes.R":'''source("util.R")
library(stats)
limit <- 3
area <- function(r, k = 1) {
  if (r > 0) stats::sd(r) else helper(r)
}
''',
"Shapes.jl":'''module Shapes
using Base: sqrt, sin
import ..Core
abstract type Shape end
struct Circle <: Shape
  r::Float64
end
function area(c::Circle)
  if c.r > 0
    return compute(c.r)
  end
end
Base.show(io, c) = print(io, c)
double(x) = 2x
end
const LIMIT = 3
''',
"Core/Engine.cs":'''using System.Text;
using Pkg.Shapes;
namespace Pkg.Core {
public interface IRun : IBase { void Go(); }
public class Engine : Base, IRun {
    public int N { get; set; }
    enum Mode { On, Off }
    public Engine(int a) : base(a) { }
    public List<int> Go(int a) { if (a > 0) { return new List<int>(helper(a)); } return Other.Make(a); }
}
}
''',
"Core/Engine.php":'''<?php
namespace Pkg\\Core;
use Pkg\\Shapes\\Circle as C;
require_once __DIR__ . '/util.php';
interface Run extends Base { public function go(); }
class Engine extends Base implements Run {
    use Loud;
    private $n = 1;
    public function go($a) { if ($a) { $x = helper($a); return $this->other($x); } return new C($a); }
}
function top($x) { return helper($x); }
$limit = 3;
''',
"Engine.scala":'''package pkg.core
import pkg.shapes.{Circle => C, Square}
import scala.math._
trait Run extends Base { def go(a: Int): Int }
class Engine(a: Int) extends Base(a) with Run {
  def go(b: Int): Int = { if (b > 0) helper(b) else Other.make(b) }
}
object Main { def main(args: Array[String]): Unit = { println(args) } }
val limit = 3
''',
"Core/Engine.hs":'''module Pkg.Core.Engine where
import Pkg.Shapes (Circle, area)
import qualified Data.Map as M
data Engine = Engine Int
class Run a where
  go :: a -> Int
instance Run Engine where
  go (Engine n) = helper n
top :: Int -> Int
top x = if x > 0 then helper x else M.size x
limit = 3
''',
"Core/Engine.ex":'''defmodule Pkg.Core.Engine do
  @behaviour Pkg.Run
  alias Pkg.Shapes.Circle, as: C
  import Enum, only: [map: 2]
  def go(a) do
    if a do
      helper(a)
    end
    C.make(a)
  end
  defp helper(x), do: map(x, 1)
end
defprotocol Pkg.Show do
  def show(x)
end
defimpl Pkg.Show, for: Engine do
  def show(x), do: to_string(x)
end
''',
"core/engine.lua":'''local util = require("core.util")
local Engine = {}
local limit = 3
local function helper(x)
  if x and x > 0 then return util.go(x) end
end
function Engine.make(r)
  return setmetatable({r = r}, {__index = Base})
end
function Engine:run() for i = 1, 2 do helper(i) end end
setmetatable(Engine, { __index = Base })
''',
}

#: file: (module, symbols as kind and path, calls as path and name, heritage)
WANT = {
    "src/net.rs": ("pkg::net", "variable LIMIT, interface Draw, method Draw::draw, class Client, method Client::draw, function inner::f", "Client::draw>help, Client::draw>Vec::new, inner::f>g", "Draw inherits Base, Client implements Draw"),
    "src/index.ts": ("pkg::src", "variable x, interface Shape, class Circle, method Circle::constructor, method Circle::area, variable LIMIT, function helper", "Circle::area>Math.sqrt, Circle::area>helper, helper>b", "Shape inherits Base, Circle inherits Round, Circle implements Shape"),
    "core/Engine.kt": ("pkg::core::Engine", "interface Run, method Run::go, class Engine, class Engine::Companion, method Engine::Companion::make, method Engine::go, function top, variable LIMIT", "Engine::Companion::make>Engine, Engine::go>start, top>helper", "Engine inherits Base, Engine inherits Run"),
    "shapes/circle.c": ("pkg::shapes::circle", "variable MAX, function SQ, class point, class pt, class color, variable color::RED, variable color::GREEN, variable counter, function area, function area2", "area2>area, area2>draw", ""),
    "core/Engine.java": ("acme::core::Engine", "class Engine, class Engine::Mode, variable Engine::Mode::ON, variable Engine::Mode::OFF, method Engine::Engine, method Engine::go, interface Run", "Engine::go>ArrayList, Engine::go>make, Engine::go>other, Engine::go>max", "Engine inherits Base, Engine implements Run, Engine implements Other, Run inherits X"),
    "shapes/circle.go": ("pkg::shapes", "interface Shape, class Circle, method Circle::Area, function helper, variable Limit", "Circle::Area>Sqrt, Circle::Area>helper, helper>Println", "Shape inherits Base"),
    "lib/util.sh": ("pkg::lib::util", "variable LIMIT, function greet", "greet>echo, greet>run_it, >greet", ""),
    "shapes/Circle.cpp": ("pkg::shapes::Circle", "class geo::Circle, method geo::Circle::Circle, method geo::Circle::area, method geo::Circle::size, function geo::free_fn", "geo::Circle::area>compute, geo::Circle::size>helper, geo::free_fn>other::go", "Circle inherits Shape, Circle inherits Other"),
    "Shapes/Circle.swift": ("pkg::Shapes::Circle", "interface Shape, method Shape::area, class Circle, method Circle::init, method Circle::area, method Circle::show, class Mode, variable Mode::on, variable Mode::off, variable limit, function top", "Circle::area>compute, Circle::show>print, top>helper", "Circle inherits Round, Circle inherits Shape, Circle inherits Printable"),
    "lib/circle.rb": ("pkg::lib::circle", "variable LIMIT, class Geo, class Geo::Circle, method Geo::Circle::initialize, method Geo::Circle::make, method Geo::Circle::area, function top", "Geo::Circle::area>compute, top>helper", "Circle inherits Shape"),
    "lib/shapes.R": ("pkg::lib::shapes", "variable limit, function area", "area>sd, area>helper, >source, >library", ""),
    "Shapes.jl": ("pkg::Shapes", "class Shapes, interface Shapes::Shape, class Shapes::Circle, function Shapes::area, method Shapes::show, function Shapes::double, variable LIMIT", "Shapes::area>compute, Shapes::show>print", "Circle inherits Shape"),
    "Core/Engine.cs": ("pkg::Core::Engine", "interface Pkg::Core::IRun, class Pkg::Core::Engine, class Pkg::Core::Engine::Mode, variable Pkg::Core::Engine::Mode::On, variable Pkg::Core::Engine::Mode::Off, method Pkg::Core::Engine::Engine, method Pkg::Core::Engine::Go", "Pkg::Core::Engine::Go>List, Pkg::Core::Engine::Go>helper, Pkg::Core::Engine::Go>Other.Make", "IRun inherits IBase, Engine inherits Base, Engine implements IRun"),
    "Core/Engine.php": ("pkg::Core::Engine", "interface Pkg::Core::Run, method Pkg::Core::Run::go, class Pkg::Core::Engine, method Pkg::Core::Engine::go, function Pkg::Core::top, variable Pkg::Core::limit", "Pkg::Core::Engine::go>helper, Pkg::Core::Engine::go>other, Pkg::Core::Engine::go>C, Pkg::Core::top>helper", "Engine inherits Base, Engine implements Run, Engine implements Loud"),
    "Engine.scala": ("pkg::Engine", "interface Run, method Run::go, class Engine, method Engine::go, class Main, method Main::main, variable limit", "Engine::go>helper, Engine::go>Other.make, Main::main>println", "Run inherits Base, Engine inherits Base, Engine implements Run"),
    "Core/Engine.hs": ("pkg::Core::Engine", "class Engine, interface Run, method Run::go, function top, variable limit", "top>helper, top>M.size", "Engine inherits Run"),
    "Core/Engine.ex": ("pkg::Core::Engine", "class Engine, method Engine::go, method Engine::helper, interface Show, method Show::show, class Show", "Engine::go>helper, Engine::go>make, Engine::helper>map, Show::show>to_string", "Engine implements Run, Engine implements Show"),
    "core/engine.lua": ("pkg::core::engine", "variable util, variable Engine, variable limit, function helper, method Engine::make, method Engine::run", "helper>util.go, Engine::make>setmetatable, Engine::run>helper", "Engine inherits Base"),
}
IMPORTS = {
    "src/net.rs": "pkg::util help+O, external::std HashMap, pkg::x x", "src/index.ts": "pkg::src::util b+c, external::react React, pkg::y x", "core/Engine.kt": "pkg::core::Other O, external::kotlin ",
    "shapes/circle.c": "pkg::core::engine , external::sys ", "core/Engine.java": "acme::shapes::Shape Shape, external::java max, external::java ", "shapes/circle.go": "external::fmt fmt, external::math m, pkg::core core",
    "lib/util.sh": "pkg::lib::other ", "shapes/Circle.cpp": "pkg::shapes::Circle , external::std vector", "Shapes/Circle.swift": "external::Foundation Foundation", "lib/circle.rb": "pkg::lib::shape , external::json ",
    "lib/shapes.R": "pkg::lib::util , external::stats stats", "Shapes.jl": "external::Base sqrt+sin, pkg::Core ", "Core/Engine.cs": "external::System , pkg::Shapes ", "Core/Engine.php": "pkg::Shapes::Circle C, pkg::Core::util ",
    "Engine.scala": "pkg::shapes::Circle C, pkg::shapes::Square Square, external::scala ", "Core/Engine.hs": "pkg::Shapes Circle+area, external::Data M", "Core/Engine.ex": "pkg::Shapes::Circle C, external::Enum map", "core/engine.lua": "pkg::core::util util",
}


def parts(text):
    return {x for x in text.split(", ") if x}


@pytest.mark.parametrize("file", list(FILES))
def test_a_file_of_each_language(file):
    module, symbols, calls, heritage = WANT[file]
    text = FILES[file]
    assert lexed.module_id("pkg", file, text) == module
    got = lexed.Lexed("pkg", file, text, module)
    cut = lambda id: id.removeprefix(module).removeprefix("::")
    assert {f"{s[1]} {cut(s[0])}" for s in got.symbols} >= parts(symbols)
    assert len({s[0] for s in got.symbols} - {f"{module}::{x.split()[1]}" for x in parts(symbols)}) <= 1
    assert {f"{cut(a)}>{b}" for a, b, _ in got.calls} >= parts(calls)
    assert {f"{a} {r} {b}" for a, b, r, _ in got.heritage} >= parts(heritage)
    assert [f"{to} {'+'.join(names)}" for to, names, _ in got.imports] == IMPORTS[file].split(", ")
    assert all(1 <= s[3] <= (s[8] or s[3]) <= text.count("\n") + 1 for s in got.symbols)


def test_decisions_and_names():
    got = {s[2]: s for s in lexed.Lexed("pkg", "a.ts", "function f(a, b = 2) {\n  let c = 0;\n  if (a && b || c) { total = a; }\n  for (;;) { g(x => x ? 1 : 2); }\n}\n", "pkg::a").symbols}["f"]
    assert got[10] == 5 and got[5] == ["a", "b", "c"] and got[7] == ["c", "total"] and {"g", "total", "x"} <= set(got[6]) and got[9] == "function f(a, b = 2)"


def test_comments_and_strings_hide_code():
    got = lexed.Lexed("pkg", "a.go", 'package a\n// func no() {}\n/* func no() {} */\nvar s = "func no() { x() }"\nvar t = `\nfunc no() {}\n`\nfunc yes() { y("}") }\n', "pkg")
    assert [s[2] for s in got.symbols if s[1] == "function"] == ["yes"] and [c[1] for c in got.calls] == ["y"]


@pytest.mark.parametrize("file", list(FILES))
def test_broken_files_are_read_as_far_as_they_go(file):
    text = FILES[file]
    for at in range(0, len(text), 7):
        lexed.Lexed("pkg", file, text[:at], "pkg")
        lexed.Lexed("pkg", file, text[at:], "pkg")


def test_a_mixed_tree_becomes_a_graph(spark):
    rows = [("pkg", f, t, f) for f, t in FILES.items()] + [("pkg", "m.py", "def f():\n    helper(1)\n", "m.py")]
    g, _ = build.build(repo.extract(spark.createDataFrame(rows, "package string, file string, text string, path string")))
    e = {(r["src"], r["dst"], r["kind"]) for r in g.edges.collect()}
    assert ("pkg::src::Circle::area", "pkg::src::helper", "calls") in e and ("pkg::net", "external::std", "imports") in e
    assert ("pkg::net::Client", "pkg::net::Draw", "implements") in e and ("acme::core::Engine", "acme::shapes::Shape", "imports") not in e
    assert g.nodes.where("kind = 'module'").count() >= 14
