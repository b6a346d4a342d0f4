"""The report as one HTML file that needs nothing else."""

from __future__ import annotations

import html
import json
from dataclasses import asdict

from cellwright import models as m
from cellwright.plans.engine import Result
from cellwright.report import data

_PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>@TITLE@</title>
<style>
body{font:14px/1.45 system-ui,sans-serif;margin:24px;color:#1c2430;background:#fff}
h2{margin:28px 0 8px;font-size:17px}table{border-collapse:collapse;width:100%}
th,td{border-bottom:1px solid #dde3ea;padding:4px 8px;text-align:left;vertical-align:top;white-space:pre-wrap;word-break:break-word}
th{cursor:pointer;background:#f5f7fa}.cards{display:flex;flex-wrap:wrap;gap:10px}.card{border:1px solid #dde3ea;border-radius:6px;padding:8px 14px}
.card b{display:block;font-size:18px}mark{background:#ffe08a}.bar{display:flex;gap:8px;margin:8px 0}.TYPE_MISMATCH{background:#f4cccc}.VALUE_DIFF{background:#fce5cd}.NULL_MISMATCH{background:#fff2cc}.FORMAT_ONLY{background:#d9ead3}
</style>
<h1>@TITLE@</h1><div id="app"></div>
<script type="application/json" id="payload">@PAYLOAD@</script>
<script>
const P = JSON.parse(document.getElementById('payload').textContent), app = document.getElementById('app');
const el = (tag, text, cls) => { const e = document.createElement(tag); if (text != null) e.textContent = text; if (cls) e.className = cls; return e; };
const title = text => app.append(el('h2', text));
// the parts of two texts that differ, between their common start and end
function parts(a, b) {
  a = a ?? ''; b = b ?? '';
  let s = 0, e = 0;
  while (s < a.length && s < b.length && a[s] === b[s]) s++;
  while (e < a.length - s && e < b.length - s && a[a.length - 1 - e] === b[b.length - 1 - e]) e++;
  return [a, b].map(x => [x.slice(0, s), x.slice(s, x.length - e), x.slice(x.length - e)]);
}
function marked(p) { const td = el('td'); td.append(p[0], el('mark', p[1]), p[2]); return td; }
function grid(head, rows, row) {
  const t = el('table'), h = el('tr'), body = el('tbody'); let by = -1, up = 1;
  head.forEach((x, i) => { const th = el('th', x); th.onclick = () => { up = by === i ? -up : 1; by = i; rows.sort((a, b) => up * (typeof a[i] === 'number' && typeof b[i] === 'number' ? a[i] - b[i] : String(a[i] ?? '').localeCompare(String(b[i] ?? '')))); draw(rows); }; h.append(th); });
  const draw = r => { body.replaceChildren(...r.map(row || (x => { const tr = el('tr'); x.forEach(v => tr.append(el('td', v))); return tr; }))); };
  t.append(h, body); draw(rows); return t;
}
const cards = el('div', null, 'cards');
P.verdict.forEach(([k, v]) => { const c = el('div', k, 'card'); c.prepend(el('b', v)); cards.append(c); });
app.append(cards);
if (P.schema.length) { title('Columns on one side'); app.append(grid(['column', 'only'], P.schema)); }
title('Columns'); app.append(grid(P.columnHead, P.columns));
if (P.detail.length) {
  title('Differences' + (P.diffTruncated ? ' (the first ' + P.detail.length + ')' : ''));
  const bar = el('div', null, 'bar'), status = el('select'), column = el('select'), find = el('input'), more = el('span'), size = 200; let page = 0;
  find.placeholder = 'search'; [['', 'all'], ...Object.entries(P.labels)].forEach(([v, t]) => { const o = el('option', t); o.value = v; status.append(o); });
  ['', ...new Set(P.detail.map(r => r[2]))].forEach(v => { const o = el('option', v || 'all columns'); o.value = v; column.append(o); });
  const back = el('button', '‹'), next = el('button', '›'); bar.append(status, column, find, back, next, more); app.append(bar);
  const holder = el('div'); app.append(holder);
  function show() {
    const q = find.value.toLowerCase(), rows = P.detail.filter(r => (!status.value || r[4] === status.value) && (!column.value || r[2] === column.value) && (!q || r.some(x => String(x ?? '').toLowerCase().includes(q))));
    page = Math.max(0, Math.min(page, Math.ceil(rows.length / size) - 1)); more.textContent = rows.length + ' rows, page ' + (page + 1);
    holder.replaceChildren(grid(P.detailHead, rows.slice(page * size, (page + 1) * size), r => { const tr = el('tr', null, r[4]), [b, a] = parts(r[5], r[6]); r.forEach((v, i) => tr.append(i === 5 ? marked(b) : i === 6 ? marked(a) : el('td', i === 4 ? P.labels[v] : v))); return tr; }));
  }
  status.onchange = column.onchange = find.oninput = () => { page = 0; show(); }; back.onclick = () => { page--; show(); }; next.onclick = () => { page++; show(); }; show();
}
if (P.anomalies.length) { title('Anomalies'); app.append(grid(['level', 'what', 'column', 'detail'], P.anomalies)); }
P.sides.forEach(s => { title(s.title + (s.truncated ? ' (the first ' + s.rows.length + ')' : '')); app.append(grid(s.head, s.rows)); });
if (P.warnings.length) { title('Warnings'); P.warnings.forEach(w => app.append(el('p', w))); }
</script></html>
"""


def payload(result: Result) -> dict:
    c, s = result.config.report, result.stats
    detail = list(data.detail_rows(result, c.html_max_rows)) if s.severe or s.format_only else []
    sides = []
    for which, n, title in (("b", s.only_in_before, "Rows only before"), ("a", s.only_in_after, "Rows only after")):
        if n:
            head, body = data.one_sided(result, which)
            sides.append({"title": title, "head": head, "rows": body, "truncated": len(body) < n})
    return {
        "verdict": [[n, data.number(v)] for n, v in data.verdict(result)],
        "schema": [[x, "before"] for x in s.only_before_columns] + [[x, "after"] for x in s.only_after_columns],
        "columnHead": list(m.ColumnResult("", None, "").row()), "columns": [list(r.row().values()) for r in result.columns],
        "detailHead": data.DETAIL, "detail": detail, "diffTruncated": len(detail) < s.severe + s.format_only, "labels": {k: v for k, v in m.LABELS.items() if k != m.EQUAL},
        "anomalies": [[a.level, a.title, a.column, a.detail] for a in result.anomalies], "sides": sides, "warnings": result.warnings, "stats": asdict(s),
    }


def render(result: Result) -> str:
    # "</" could end the script element, and U+2028 a line of it
    text = json.dumps(payload(result), ensure_ascii=False, default=str).replace("</", "<\\/").replace("<!--", "<\\!--")
    return _PAGE.replace("@TITLE@", html.escape(result.config.report.title)).replace("@PAYLOAD@", text)


def write(result: Result, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(result))
