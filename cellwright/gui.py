"""A local page for comparisons: an HTTP server of the standard library, on the loopback interface."""

from __future__ import annotations

import json
import mimetypes
import os
import threading
import traceback
import webbrowser
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlparse

from cellwright.config import EXTENSIONS, Config, build, dump_config

_MOST_ENTRIES = 2000

_PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>cellwright</title>
<style>body{font:14px system-ui,sans-serif;margin:24px;max-width:900px}label{display:block;margin:8px 0}input{width:60%}pre{background:#f5f7fa;padding:10px;white-space:pre-wrap}li{cursor:pointer}</style>
<h1>Compare two snapshots</h1>
<label>before <input id="before"></label><label>after <input id="after"></label><label>keys <input id="keys" placeholder="found automatically"></label>
<button id="browse">browse</button> <button id="inspect">inspect</button> <button id="run">run</button> <button id="export">export settings</button>
<ul id="files"></ul><pre id="out"></pre><div id="links"></div>
<script>
const $ = id => document.getElementById(id), out = x => $('out').textContent = typeof x === 'string' ? x : JSON.stringify(x, null, 1);
const call = (path, body) => fetch(path, {method: body ? 'POST' : 'GET', headers: {'Content-Type': 'application/json'}, body: body && JSON.stringify(body)}).then(r => r.json());
const config = () => ({before: $('before').value, after: $('after').value, keys: $('keys').value.split(',').map(x => x.trim()).filter(Boolean)});
function list(path) { call('/api/browse', {path}).then(r => { if (r.error) return out(r); $('files').replaceChildren(...[{name: '..', dir: true, path: r.parent}, ...r.entries].map(e => { const li = document.createElement('li'); li.textContent = e.name + (e.dir ? '/' : ''); li.onclick = () => e.dir ? list(e.path) : $($('before').value ? 'after' : 'before').value = e.path; return li; })); }); }
$('browse').onclick = () => list('');
$('inspect').onclick = () => call('/api/inspect', {config: config()}).then(out);
$('export').onclick = () => call('/api/export-config', {config: config()}).then(r => out(r.text || r));
$('run').onclick = () => call('/api/run', {config: config()}).then(r => r.error ? out(r) : poll());
function poll() { call('/api/status').then(s => { out(s); $('links').replaceChildren(...(s.files || []).map(f => { const a = document.createElement('a'); a.href = '/files/' + encodeURIComponent(f); a.textContent = f + ' '; return a; })); if (s.state === 'running') setTimeout(poll, 700); }); }
</script></html>"""


class Jobs:
    """One comparison at a time; starting and asking go under one lock."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.state: dict = {"state": "idle", "phase": "", "log": [], "files": [], "error": ""}
        self.folder = ""

    def start(self, config: Config) -> None:
        with self.lock:
            if self.state["state"] == "running":
                raise ValueError("a comparison is running")
            self.state = {"state": "running", "phase": "starting", "log": [], "files": [], "error": ""}
            self.folder = os.path.realpath(config.output_dir)
        threading.Thread(target=self._run, args=(config,), daemon=True).start()

    def _log(self, text: str) -> None:
        with self.lock:
            self.state["log"].append(text)
            if len(text) < 80 and "\n" not in text:
                self.state["phase"] = text

    def _run(self, config: Config) -> None:
        from cellwright.plans.engine import CompareEngine
        from cellwright.report import write_reports

        engine = None
        try:
            engine = CompareEngine(config, log=self._log)
            result = engine.run()
            self._log("writing reports")
            files = [os.path.basename(p) for p in write_reports(result, self._log).values() if p != "-" and not p.startswith("failed")]
            with self.lock:
                self.state |= {"state": "done", "phase": "done", "files": files, "consistent": result.stats.consistent, "severe": result.stats.severe, "format_only": result.stats.format_only}
        except Exception as e:  # noqa: BLE001
            with self.lock:
                self.state |= {"state": "failed", "error": str(e), "trace": traceback.format_exc()[-2000:]}
        finally:
            if engine:
                engine.close()

    def status(self) -> dict:
        with self.lock:
            return json.loads(json.dumps(self.state))


def browse(path: str, root: str | None) -> dict:
    """The folders and readable files in a folder, without hidden ones; only below root, where one is set."""
    at = os.path.realpath(path or root or os.getcwd())
    if root and os.path.commonpath([at, os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError("outside the root folder")
    if not os.path.isdir(at):
        raise ValueError(f"{at} is no folder")
    entries = []
    for e in sorted(os.scandir(at), key=lambda e: (not e.is_dir(), e.name.lower())):
        if not e.name.startswith(".") and (e.is_dir() or os.path.splitext(e.name)[1].lower() in EXTENSIONS):
            entries.append({"name": e.name, "path": e.path, "dir": e.is_dir()})
        if len(entries) == _MOST_ENTRIES:
            break
    return {"path": at, "parent": os.path.dirname(at), "entries": entries}


def _inspect(config: Config, rows: object) -> dict:
    from cellwright.plans.engine import CompareEngine

    engine = CompareEngine(config)
    try:
        return engine.inspect(max(1_000, min(200_000, int(rows or 20_000))))
    finally:
        engine.close()


def make_server(host: str = "127.0.0.1", port: int = 0, root: str | None = None) -> ThreadingHTTPServer:
    if host not in ("127.0.0.1", "localhost", "::1"):
        raise ValueError("the page has no sign-in; it is served on the loopback interface only")
    jobs = Jobs()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: object) -> None:
            pass

        def _send(self, code: int, body: bytes, kind: str) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _json(self, data: object, code: int = 200) -> None:
            self._send(code, json.dumps(data, ensure_ascii=False, default=str).encode(), "application/json; charset=utf-8")

        def do_GET(self) -> None:
            path = unquote(urlparse(self.path).path)
            if path == "/":
                self._send(200, _PAGE.encode(), "text/html; charset=utf-8")
            elif path == "/api/status":
                self._json(jobs.status())
            elif path.startswith("/files/") and jobs.folder and os.path.isfile(file := os.path.join(jobs.folder, os.path.basename(path))):
                with open(file, "rb") as f:
                    self._send(200, f.read(), mimetypes.guess_type(file)[0] or "application/octet-stream")
            else:
                self._json({"error": "not found"}, 404)

        def do_POST(self) -> None:
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if not isinstance(asked, dict):
                    raise ValueError("an object is needed")
                path = urlparse(self.path).path
                config = build(Config, asked.get("config") or {})
                if path == "/api/browse":
                    self._json(browse(asked.get("path") or "", root))
                elif path == "/api/inspect":
                    self._json(_inspect(config, asked.get("rows")))
                elif path == "/api/run":
                    jobs.start(config)
                    self._json({"started": True})
                elif path == "/api/export-config":
                    self._json({"text": dump_config(config)})
                else:
                    self._json({"error": "not found"}, 404)
            except (ValueError, FileNotFoundError, TypeError) as e:
                self._json({"error": str(e)}, 400)
            except Exception as e:  # noqa: BLE001
                self._json({"error": str(e)}, 500)

    return ThreadingHTTPServer((host, port), Handler)


def serve(host: str, port: int, root: str | None = None, browser: bool = True) -> None:
    server = make_server(host, port, root)
    url = f"http://{host}:{server.server_address[1]}/"
    print(url)
    if browser:
        webbrowser.open(url)
    try:
        server.serve_forever()
    finally:
        server.server_close()
