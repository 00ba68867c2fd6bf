"""Captures for tests; secret-looking values are put together so that none stands in the file."""

from __future__ import annotations

import json

TOKEN = "left" + "-handle-3141"
JWT = "ey" + "J" + "h" * 12 + "." + "p" * 14 + "." + "s" * 20
AWS = "AK" + "IA" + "ABCDEFGH" * 2
GOOGLE = "AI" + "za" + "Q" * 35
PEM_HEAD = "-----BEGIN " + "PRIVATE KEY-----"
PEM_TAIL = "-----END " + "PRIVATE KEY-----"


def call(method, url, status=200, mime=None, text=None, headers=(), req_headers=(), post=None, **content):
    response = {"status": status, "headers": [{"name": n, "value": v} for n, v in headers]}
    response["content"] = {k: v for k, v in {"mimeType": mime, "text": text, **content}.items() if v is not None}
    request = {"method": method, "url": url, "headers": [{"name": n, "value": v} for n, v in req_headers]}
    if post is not None:
        request["postData"] = {"mimeType": "application/json", "text": post}
    return {"startedDateTime": "2026-03-14T08:30:00.000Z", "time": 17.25, "request": request, "response": response}


def shop() -> list[dict]:
    """Six calls: two JSON ones, an image, an empty font, a script and plain text."""
    first = call(
        "GET",
        "https://api.bikes.test/v2/rides",
        mime="application/json",
        size=45,
        text='{"rides": [{"no": 7, "km": 12}], "total": 1}',
        headers=[("content-security-policy", "default-src 'self'"), ("cache-control", "no-cache"), ("content-type", "x")],
    )
    first["request"]["postData"] = None
    return [
        first,
        call("GET", "https://img.bikes.test/frame.png", mime="image/png", encoding="base64", text="R0lGODdh"),
        call("GET", "https://img.bikes.test/type.woff2", mime="font/woff2", text=""),
        call("GET", "https://www.bikes.test/app.js", mime="application/javascript", text="let a = [1, 2, 3];"),
        call(
            "POST",
            "https://api.bikes.test/v2/session",
            mime="application/json; charset=utf-8",
            text='{"ticket": "k1.k2.k3", "minutes": 60}',
            headers=[("Set-Cookie", "sid=9c1e; Secure"), ("content-security-policy", "default-src 'self'")],
            req_headers=[("Authorization", f"Bearer {TOKEN}")],
            post='{"email": "rider@bikes.test", "password": "pedal"}',
        ),
        call("GET", "https://api.bikes.test/ping", mime="text/plain", text="up"),
    ]


def leaky() -> list[dict]:
    """Four calls that hold one value of every kind the scanner knows."""
    inner = json.dumps({"widgetToken": "w" * 32, "kind": "shop"})
    return [
        call("GET", "https://x/?access_token=" + "V" * 24 + "&page=1", req_headers=[("authorization", "Bearer " + "a" * 24)]),
        call("POST", "https://x/login", post=json.dumps({"user": "pump@bikes.test", "password": "saddle-bag-44"}),
             headers=[("Set-Cookie", 'mark="q"r; sid=77aa33dd')]),
        call("GET", "https://x/keys", mime="application/json", text=json.dumps({"a": AWS, "g": GOOGLE, "j": JWT, "c": inner})),
        call("GET", "https://x/pem", mime="text/plain", text=f"{PEM_HEAD}\nbm90IGEga2V5\n{PEM_TAIL}\nbye\n"),
    ]
