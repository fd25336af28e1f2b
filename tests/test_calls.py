"""Client calls of any extent, variables at the time of the call, braces that are not code."""

from tracewell.operators import code_scan, routes
from tracewell.sources import catalog

FILE = '''import x from "y";
export const first = async (id: string) => {
  const s = "}"; // a } in a comment
  const t = `multi
  } line {`;
  /* } */
  return client.get<
    Map<string, A<B>>,
    b,
    c,
    d,
    e,
    f,
    g,
    h,
    i,
    j
  >(
    `/api/first/${id}`,
    (x) => { call(x); }
  );
};
export async function second() {
  let url = "/api/old";
  if (a) {
    const url = "/api/inner";
    use(url);
  }
  url = "/api/new";
  const r = await client.post(url, { a: ")" });
  if (b) {
    const url = "/api/shadow";
    await client.put(
      url,
      data
    );
  }
  return client.delete(url);
}
export const third = () => {
  client.get(other);
  const z = "/api/not/of/the/call";
};
client["patch"]("/api/outside");
'''


def test_calls(spark):
    files = spark.createDataFrame([(1, "a.ts", FILE), (2, "b.ts", ""), (3, "c.py", FILE), (4, "d.ts", None)], "file_id long, path string, text string")
    got = {(r.function_name, r.method, r.url) for r in routes.http_call_url(files).collect()}
    assert got == {
        ("first", "GET", "/api/first/{id}"), ("second", "POST", "/api/new"), ("second", "PUT", "/api/shadow"), ("second", "DELETE", "/api/new"),
        ("unknown", "PATCH", "/api/outside")}
    held = {(r.function_name, r.variable, r.url) for r in routes.http_call_url_var(files).collect()}
    assert held == {("second", "url", "/api/new"), ("second", "url", "/api/shadow")}


def test_scope_ignores_braces_in_strings(spark):
    files = spark.createDataFrame([(1, "a.ts", FILE)], "file_id long, path string, text string")
    lines = FILE.split("\n")
    got = {r.line_no: r.function_name for r in code_scan.function_scope(catalog.scanned_lines(files)).collect()}
    last = lambda word: next(i for i, line in enumerate(lines, 1) if word in line)
    assert got[last("call(x)")] == got[last("} line")] == "first" and got[last("not/of")] == "third"
    assert got[last('"patch"')] is None and got[1] is None
