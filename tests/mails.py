"""Thirteen mails written for these tests, and what each must give."""

from __future__ import annotations

import base64


def compose(headers: dict[str, str], text: str = "", html: str = "", files=()) -> bytes:
    """A mail with a text part, an HTML part and `(name, type, bytes)` files."""
    lines = [f"{name}: {value}" for name, value in headers.items()]
    if not html and not files:
        lines += ["MIME-Version: 1.0", 'Content-Type: text/plain; charset="utf-8"', "", text]
        return "\n".join(lines).encode()
    lines += ["MIME-Version: 1.0", 'Content-Type: multipart/mixed; boundary="cut-here"', ""]
    for kind, body in (("plain", text), ("html", html)):
        if body:
            lines += ["--cut-here", f'Content-Type: text/{kind}; charset="utf-8"', "", body]
    for name, kind, content in files:
        lines += [
            "--cut-here",
            f'Content-Type: {kind}; name="{name}"',
            f'Content-Disposition: attachment; filename="{name}"',
            "Content-Transfer-Encoding: base64",
            "",
            base64.b64encode(content).decode(),
        ]
    return "\n".join([*lines, "--cut-here--", ""]).encode()


def auth(spf: str, dkim: str, dmarc: str) -> str:
    return f"mx.example.com;\n    spf={spf} smtp.mailfrom=x.example;\n    dkim={dkim};\n    dmarc={dmarc}"


def _alert(sender: str, mailer: str, ip: str, short: str) -> bytes:
    return compose(
        {
            "From": f"Microsoft Security <security@{sender}>",
            "To": "someone@lagoon.example",
            "Subject": "Urgent notice about your account",
            "Date": "Fri, 07 Mar 2025 06:20:00 +0000",
            "Message-ID": f"<n1@{sender}>",
            "Reply-To": f"security@{sender}",
            "Return-Path": f"<bounce@{mailer}>",
            "Authentication-Results": auth("fail", "none", "fail"),
        },
        f"Please verify your identity or your account will be suspended.\n"
        f"Click here: http://{ip}/verify?id=1\nAct now.\nMicrosoft security team",
        f'<html><body><p><a href="http://{ip}/verify?id=1">https://login.microsoft.com/verify</a></p>'
        f'<p><a href="https://bit.ly/{short}">Verify today</a></p></body></html>',
    )


MAILS: dict[str, bytes] = {
    "simple": compose(
        {
            "From": "Ines Halvorsen <ines@harbour.example>",
            "To": "theo@harbour.example",
            "Subject": "Boat on Sunday",
            "Date": "Tue, 04 Mar 2025 18:05:00 +0000",
            "Message-ID": "<h-7@mx.harbour.example>",
        },
        "Hello Theo,\n\nis the boat ready?\n",
    ),
    "multipart": compose(
        {
            "From": "Kiln Club <post@kilnclub.example>",
            "To": "potter@clay.example",
            "Subject": "Glaze notes",
            "Date": "Wed, 05 Mar 2025 07:10:00 +0000",
            "Message-ID": "<g-3@kilnclub.example>",
            "Reply-To": "desk@kilnclub.example",
            "Return-Path": "<back@kilnclub.example>",
        },
        "News at https://kilnclub.example/glazes\n",
        '<html><body><h1>Glaze notes</h1><a href="https://kilnclub.example/glazes">All glazes</a></body></html>',
    ),
    "malformed": compose(
        {"From": "broken-sender", "Subject": "=?utf-8?B?not base64?=", "Date": "not-a-real-date"},
        "The headers of this mail are broken.\n",
    ),
    "missing_headers": b'Content-Type: text/plain; charset="utf-8"\n\nThis mail has no headers to speak of.\n',
    "with_attachments": compose(
        {
            "From": "Odile Brandt <odile@orchard.example>",
            "To": "wim@orchard.example",
            "Subject": "A document",
            "Date": "Thu, 06 Mar 2025 12:45:00 +0000",
            "Message-ID": "<o-9@mx.orchard.example>",
        },
        "The document you wanted.\n",
        files=[
            ("report.pdf", "application/pdf", b"%PDF-1.4 nothing"),
            ("invoice.pdf.exe", "application/octet-stream", b"MZ nothing"),
        ],
    ),
    "phishing_links": _alert("micros0ft-desk.com", "postbulk.net", "10.20.30.41", "q7-verify"),
    "fake-microsoft-alert": _alert("micros0ft-help.com", "manymails.net", "10.20.30.77", "x2-verify"),
    "benign-newsletter": compose(
        {
            "From": "Pond Letters <letters@pondletters.example>",
            "To": "heron@marsh.example",
            "Subject": "Reed bed, part 9",
            "Date": "Sat, 08 Mar 2025 05:30:00 +0000",
            "Message-ID": "<r-9@mx.pondletters.example>",
            "Reply-To": "letters@pondletters.example",
            "Return-Path": "<back@pondletters.example>",
            "Authentication-Results": auth("pass", "pass", "pass"),
        },
        "Herons seen at https://pondletters.example/reed/9\n",
        '<html><body><a href="https://pondletters.example/reed/9">Read on</a>'
        '<a href="https://pondletters.example/leave">Leave</a></body></html>',
    ),
    "invoice-phish": compose(
        {
            "From": "Accounting Department <desk@quarry-bills.net>",
            "To": "ledger@bakery.example",
            "Subject": "Invoice 77-B",
            "Date": "Sun, 09 Mar 2025 20:40:00 +0000",
            "Message-ID": "<b77@quarry-bills.net>",
            "Reply-To": "money@quarry-bills.net",
            "Return-Path": "<back@quarry-bills.net>",
            "Authentication-Results": auth("softfail", "none", "none"),
        },
        "Please process this payment soon. Questions go to our billing department.\n",
        files=[("bill-77.xlsm", "application/vnd.ms-excel", b"PK nothing")],
    ),
    "password-reset-legit": compose(
        {
            "From": "GitHub <hello@github.com>",
            "To": "coder@workshop.example",
            "Subject": "You asked to start over",
            "Date": "Mon, 10 Mar 2025 11:55:00 +0000",
            "Message-ID": "<s-1@github.com>",
            "Reply-To": "hello@github.com",
            "Return-Path": "<hello@github.com>",
            "Authentication-Results": auth("pass", "pass", "pass"),
        },
        "Choose a new one at\nhttps://github.com/start/confirm?step=2\n",
        '<html><body><a href="https://github.com/start/confirm?step=2">Go on</a></body></html>',
    ),
    "shipping-notification-phish": compose(
        {
            "From": "DHL Express <parcels@dhl-depot-north.com>",
            "To": "neighbour@hill.example",
            "Subject": "Box at the depot - Action Required",
            "Date": "Tue, 11 Mar 2025 13:15:00 +0000",
            "Message-ID": "<d-5@dhl-depot-north.com>",
            "Reply-To": "boxes@dhl-depot-north.com",
            "Return-Path": "<back@sendloads.xyz>",
            "Authentication-Results": auth("fail", "none", "fail"),
        },
        "Click here to have it brought again: https://t.ly/box-5\nAnswer within 48 hours.\n",
        '<html><body><a href="https://t.ly/box-5">Bring it again</a></body></html>',
    ),
    "bank-phish-polish": compose(
        {
            "From": "mBank Centrum <biuro@mbank-centrum24.pl>",
            "To": "sowa@las.example",
            "Subject": "Pilne: konto mBank",
            "Date": "Wed, 12 Mar 2025 09:35:00 +0000",
            "Message-ID": "<c-2@mbank-centrum24.pl>",
            "Reply-To": "biuro@mbank-centrum24.pl",
            "Return-Path": "<zwrot@hurtlist.xyz>",
            "Authentication-Results": auth("fail", "none", "fail"),
        },
        "Twoje konto zostanie zablokowane. Kliknij w link:\nhttp://10.44.7.9/wejscie?krok=3\n"
        "Weryfikacja konta jest potrzebna natychmiast.\n",
        '<html><body><a href="http://10.44.7.9/wejscie?krok=3">https://online.mbank.pl/wejscie</a></body></html>',
    ),
    "gift-card-scam": compose(
        {
            "From": "Uncle Bartholomew <bartholomew.at.sea@gmail.com>",
            "To": "niece@pier.example",
            "Subject": "From the boat",
            "Date": "Thu, 13 Mar 2025 17:25:00 +0000",
            "Message-ID": "<u-4@mail.gmail.com>",
            "Return-Path": "<bartholomew.at.sea@gmail.com>",
            "Authentication-Results": auth("pass", "pass", "pass"),
        },
        "I urgently need you to get gift cards. Scratch the back and send me the codes.\n",
    ),
}

# name -> (findings, raw points, score, level, {category: (points, count)})
OUTCOMES = {
    "simple": (1, 10, 10, "low", {"authentication": (10, 1)}),
    "multipart": (1, 10, 10, "low", {"authentication": (10, 1)}),
    "malformed": (3, 18, 18, "low", {"authentication": (10, 1), "sender_identity": (8, 2)}),
    "missing_headers": (3, 18, 18, "low", {"authentication": (10, 1), "sender_identity": (8, 2)}),
    "with_attachments": (3, 80, 80, "high", {"attachments": (70, 2), "authentication": (10, 1)}),
    "phishing_links": (19, 290, 100, "critical", {
        "authentication": (79, 4), "content": (84, 6), "links": (87, 7), "sender_identity": (40, 2)}),
    "benign-newsletter": (0, 0, 0, "low", {}),
    "fake-microsoft-alert": (19, 290, 100, "critical", {
        "authentication": (79, 4), "content": (84, 6), "links": (87, 7), "sender_identity": (40, 2)}),
    "invoice-phish": (8, 88, 88, "critical", {
        "attachments": (30, 2), "authentication": (18, 3), "content": (20, 2), "sender_identity": (20, 1)}),
    "password-reset-legit": (1, 4, 4, "low", {"links": (4, 1)}),
    "shipping-notification-phish": (8, 123, 100, "critical", {
        "authentication": (79, 4), "content": (14, 2), "links": (10, 1), "sender_identity": (20, 1)}),
    "bank-phish-polish": (14, 242, 100, "critical", {
        "authentication": (79, 4), "content": (74, 5), "links": (69, 4), "sender_identity": (20, 1)}),
    "gift-card-scam": (2, 30, 30, "low", {"content": (30, 2)}),
}
