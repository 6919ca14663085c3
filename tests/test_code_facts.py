"""Code tokens and the facts made of them, on cases with nested templates, regular expressions, generics and lifetimes."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.operators import code_facts as C
from strataloom.sources.code_tokens import code_tokens, read_tokens

SCRIPT = r"""#!/usr/bin/env node
// import no from 'comment'
import def, { a as b, type C, d } from "./m";
import * as ns from 'space'
import type T from './types';
import 'side';
export * from "pkg";
export { x1, y1 as z1 } from './other';
/* import y from 'none'
class Not {} */
const re = /[/"'`]if/g.test(x) / 2, tpl = `a${ fn({ k: `in${1}`, if: 2 }) } class Fake {} ${x ? 1 : 2}`;
export async function go<T extends { a: string }>(p: T, q?: number): Promise<{ ok: boolean }> {
  if (p && q) { for (const x of [1]) { while (x) {} } }
  const inner = () => { if (a || b) {} };
  return items.map(x => x ? 1 : 2) ?? lazy(() => import('./lazy'));
}
function over(a: string): void;
function over(a: number): void;
function over(a: unknown) { do { a ||= 1 } while (a) }
class Box<T> extends Base<{ a: T }> {
  get value() { return this.x ? 1 : 2 }
}
export default class Named {}
interface Shape { kind: typeof import('./kind'); if: boolean }
export type Fn = (a: number) => { b: string }
type Cond<T> = T extends string ? 1 : 2
export const enum Color { Red }
declare namespace Deep.Inner { const x: 1 }
let m: Map<string, number> = new Map(), { lost } = y, arrow = async (x: number): Promise<void> => { switch (x) { case 1: break; case 2: try {} catch (e) {} } }
var short = v => v && w
const plain = (1 + 2)
  * 3
const load = { page: import("./page") }
export { short, arrow as renamed }
export default plain
"""

RUST = r'''#![allow(dead_code)]
use std::{fmt, io::Read};
use serde::Serialize as S;
pub use ::tokio::sync::*;
use crate::x;
use {rand, r#log::info};
extern crate alloc as a;
/* use none::at; /* nested */ struct Not; */
/// Docs with fn fake() {}
#[derive(Debug)]
pub struct Point<'a, T: 'a> { x: &'a T, c: char }
pub(crate) enum Kind { A { b: i32 }, C }
pub async unsafe fn run<'a>(s: &'a str) -> Result<(), ()> where 'a: 'static {
    use inner::thing;
    let q = '\''; let r = r#"fn raw() { "quoted" }"#; let l: &'static str = "} fn s() {";
}
impl<'a, T> fmt::Display for Point<'a, T> where T: Clone {
    fn fmt(&self) -> fmt::Result { Ok(()) }
    pub const fn new() -> Self { loop {} }
    #[test]
    fn skipped() {}
}
impl Kind { pub fn of() {} }
pub const LIMIT: usize = 3;
static mut COUNT: u8 = b'x';
pub trait Walk { fn step(&self); }
type Alias<T> = Vec<T>;
macro_rules! make { () => { struct Made; } }
#[cfg(test)]
mod tests { fn t() {} }
#[cfg(not(test))]
mod real {}
#[test]
fn alone() {}
'''


@pytest.fixture(scope="module")
def tokens(spark):
    return code_tokens(spark.createDataFrame([("a.ts", SCRIPT), ("empty.ts", ""), ("null.ts", None)], "path string, text string")).cache()


def test_declarations(tokens):
    got = {(r.name, r.kind, r.line, r.end_line, r.exported) for r in C.declarations(tokens).collect()}
    assert got == {
        ("re", "const", 11, 11, False), ("tpl", "const", 11, 11, False), ("go", "function", 12, 16, True),
        ("over", "function", 17, 17, False), ("over", "function", 18, 18, False), ("over", "function", 19, 19, False),
        ("Box", "class", 20, 22, False), ("Named", "class", 23, 23, True), ("Shape", "interface", 24, 24, False), ("Fn", "type", 25, 25, True), ("Cond", "type", 26, 26, False),
        ("Color", "enum", 27, 27, True), ("Deep", "namespace", 28, 28, False), ("m", "let", 29, 29, False), ("arrow", "let", 29, 29, True), ("short", "var", 30, 30, True),
        ("plain", "const", 31, 32, True), ("load", "const", 33, 33, False),
    }


def test_imports(tokens):
    got = sorted((r.specifier, r.line, r.dynamic) for r in C.imports(tokens).collect())
    assert got == [("./lazy", 15, True), ("./m", 3, False), ("./other", 8, False), ("./page", 33, True), ("./types", 5, False), ("pkg", 7, False), ("side", 6, False), ("space", 4, False)]
    bound = {(r.local, r.specifier, r.exported) for r in C.import_bindings(tokens).collect()}
    assert bound == {("def", "./m", "default"), ("b", "./m", "a"), ("C", "./m", "C"), ("d", "./m", "d"), ("ns", "space", "*"), ("T", "./types", "default")}


def test_complexity(tokens):
    got = {(r.name, r.line): r.complexity for r in C.complexity(tokens, C.declarations(tokens)).collect()}
    assert got == {("go", 12): 6, ("over", 19): 3, ("arrow", 29): 4, ("short", 30): 2}


def test_copies(spark):
    one = "export function total(items: Item[], tax = 3) {\n  let sum = 0; // running\n  for (const item of items) { if (item.price > 'x') sum += item.price * `${tax}` }\n  return sum\n}\n"
    two = "function other(rows: Row[],\n  rate = 99) { let n = 1; for (const r of rows) { if (r.cost > \"a long\") n += r.cost * `${rate}` }\n return n }\nconst tiny = () => 1\n"
    three = two.replace("+=", "-=")
    t = code_tokens(spark.createDataFrame([("1.ts", one.replace("export ", "")), ("2.ts", two), ("3.ts", three)], "path string, text string"))
    got = {r.path: (r.name, r.fingerprint) for r in C.copy_fingerprints(t, C.declarations(t)).collect()}
    assert len(got) == 3 and got["1.ts"][1] == got["2.ts"][1] != got["3.ts"][1]


def test_rust(spark):
    t = code_tokens(spark.createDataFrame([("a.rs", RUST)], "path string, text string"), rust=True)
    got = {(r.name, r.line, r.end_line, r.exported) for r in C.rust_outline(t).collect()}
    assert got == {
        ("Point", 11, 11, True), ("Kind", 12, 12, False), ("run", 13, 16, True), ("Point::fmt", 18, 18, False), ("Point::new", 19, 19, True), ("Kind::of", 23, 23, True), ("LIMIT", 24, 24, True),
        ("COUNT", 25, 25, False), ("Walk", 26, 26, True), ("Alias", 27, 27, False), ("make", 28, 28, False), ("real", 32, 32, False),
    }
    roots = {(r.root, r.kind) for r in C.rust_roots(t).collect()}
    assert roots == {("std", "use"), ("serde", "use"), ("tokio", "use"), ("rand", "use"), ("log", "use"), ("alloc", "externCrate"), ("inner", "use")}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\"'`${}()[]/\\*=>#r.,;?&|<"), max_size=60), st.booleans())
def test_tokens_cover_any_text(text, rust):
    rows = read_tokens(text, rust)
    assert all(text[r[5] : r[6]] == r[2] and r[5] < r[6] for r in rows)
    assert all(a[6] <= b[5] for a, b in zip(rows, rows[1:]))
    assert [r[0] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert r[3] == 1 + text.count("\n", 0, r[5]) and r[7] >= 0
        if r[9] is not None:
            assert rows[r[9]][9] == r[0] and rows[r[9]][7] == r[7]


HEADS = [
    ("a.ts", "export function f<T extends { a: string }>(x: T,\n  y = { z: 1 }): Promise<{ ok: boolean }> {\n  return g(x)\n}", "export function f<T extends { a: string }>(x: T, y = { z: 1 }): Promise<{ ok: boolean }> {"),
    ("a.ts", "function f(a: string): { b: number } {\n  return a }", "function f(a: string): { b: number } {"),
    ("a.ts", "function f(a: string): void;\nfunction f(a: number): void;\nfunction f(a: unknown) { body() }", "function f(a: string): void; function f(a: number): void; function f(a: unknown) {"),
    ("a.ts", "function f(a: string): void;\n// comment\nfunction f(a: unknown) { body() }", "function f(a: string): void;"),
    ("a.ts", "/** Docs. */\n@deco()\nexport const f = async (a: Map<string, number>) => {\n  x\n}", "/** Docs. */ @deco() export const f = async (a: Map<string, number>) => {"),
    ("a.ts", "const f = (a) => a +\n  1", "const f = (a) => a + 1"),
    ("a.ts", "private static async load<T>(id: string) {\n  if (x) {}\n}", "private static async load<T>(id: string) {"),
    ("a.ts", "interface A { x: 1;\n y: 2 }", "interface A { x: 1; y: 2 }"),
    ("a.ts", "export class A {\n  m() { return 1 }\n}", "export class A { m() { return 1 } }"),
    ("a.rs", "#[inline]\npub(crate) fn run<'a, T>(x: &'a T) -> Result<(), E>\nwhere T: Fn() -> X, {\n  body();\n}", "#[inline] pub(crate) fn run<'a, T>(x: &'a T) -> Result<(), E> where T: Fn() -> X, {"),
    ("a.rs", "fn step(&self) -> char;", "fn step(&self) -> char;"),
    ("a.rs", "fn c(x: char) -> bool { x == '{' }", "fn c(x: char) -> bool {"),
    ("a.rs", "pub struct P { a: u8 }", "pub struct P { a: u8 }"),
    ("a.ts", "f(a: '{', b = `${x}{`) { y }", "f(a: '{', b = `${x}{`) {"),
    ("a.ts", "", ""),
]


def test_signatures(spark):
    rows = [(i, path, text) for i, (path, text, _) in enumerate(HEADS)]
    got = {int(r.id): r.signature for r in C.signatures(spark.createDataFrame([*rows, (99, "a.ts", None)], "id long, path string, text string")).collect()}
    assert got.pop(99) is None
    assert got == {i: want for i, (_, _, want) in enumerate(HEADS)}


def test_changes_of_surface_and_inside(spark):
    f = "export function f(a: number) {{\n  return {}\n}}"
    one = [("in", "a.ts", f.format(1)), ("out", "a.ts", f.format(1)), ("same", "a.ts", f.format(1)), ("gone", "a.ts", "x"), ("type", "a.ts", "type A = 1")]
    two = [("in", "a.ts", f.format(2)), ("out", "a.ts", f.format(1).replace("number", "string")), ("same", "a.ts", f.format(1)), ("new", "a.ts", "x"), ("type", "a.ts", "type A = 2")]
    got = C.signature_changes(*(spark.createDataFrame(x, "id string, path string, text string") for x in (one, two))).collect()
    assert {r.id: r.change for r in got} == {"in": "internal", "out": "surface", "same": "same", "gone": "removed", "new": "added", "type": "surface"}


def test_digits_that_are_no_decimals_are_read(spark):
    assert [r[1:3] for r in read_tokens("x² = ½ + ٣.5")] == [["name", "x²"], ["mark", "="], ["name", "½"], ["mark", "+"], ["number", "٣.5"]]
    assert [r[2] for r in read_tokens("² .²", rust=True)] == ["²", ".", "²"]


def test_bodies_of_declarations_without_code(tokens):
    declared = C.declarations(tokens)
    one, two = (sorted(map(tuple, C.complexity(tokens, d).collect())) for d in (declared, declared.drop("code")))
    assert one == two and len(one) == 4
