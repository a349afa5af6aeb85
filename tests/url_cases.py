"""URLs with the values the URL functions must give, worked out by hand from the rules.

Canonical URL: scheme and host lower-cased, ``:80`` then ``:443`` cut, host
variations rewritten, path lower-cased without trailing slashes (``/`` if
empty), ``;params`` of the last segment and the fragment dropped, query
decoded, tracking names and empty values dropped, sorted by name, encoded.
"""

#: URL, canonical URL, domain, stripped URL; None where the URL does not parse.
HOSTILE = [
    ('HTTPS://WWW.Ex.com:443/A/', 'https://ex.com/a', 'ex.com', 'https://WWW.Ex.com/A/'),
    ('http://a:80443', 'http://a:80443/', 'a', 'http://a:80443'),
    ('http://ex.com:80:443', 'http://ex.com:80/', 'ex.com', 'http://ex.com:80'),
    ('http://ex.com:443:80', 'http://ex.com/', 'ex.com', 'http://ex.com'),
    ('www.x.com/a', 'www.x.com/a', '', '://www.x.com/a'),
    ('mailto:a@b.c', 'mailto:a@b.c', '', 'mailto://a@b.c'),
    ('http://[::1', None, None, 'http://[::1'),
    ('http://a/p;v=1?q#f', 'http://a/p', 'a', 'http://a/p'),
    ('http://am.m.x', 'http://am.x/', 'am.x', 'http://am.m.x'),
    ('http://w3.m.m.x/', 'http://w3.m.x/', 'w3.m.x', 'http://w3.m.m.x/'),
    ('http://mywww.com/', 'http://mycom/', 'mycom', 'http://mywww.com/'),
    ('http://www.www.x.com', 'http://x.com/', 'x.com', 'http://www.www.x.com'),
    ('http://x-mobile.y.com/', 'http://x.y.com/', 'x.y.com', 'http://x-mobile.y.com/'),
    ('//h/p', '//h/p', 'h', '://h/p'),
    ('http:///x', 'http:///x', '', 'http:///x'),
    ('http://x.com//', 'http://x.com/', 'x.com', 'http://x.com//'),
    ('http://h/a?é=ü&x=a+b', 'http://h/a?x=a+b&%C3%A9=%C3%BC', 'h', 'http://h/a'),
    ('http://u@h:80/', 'http://u@h/', 'u@h', 'http://u@h/'),
    ('http://x.com?#', 'http://x.com/', 'x.com', 'http://x.com'),
    ('http://x.com/?b=2&a=1&a=0&b=', 'http://x.com/?a=1&a=0&b=2', 'x.com', 'http://x.com/'),
    ('http://x.com/?q=a%20%zz+b~*', 'http://x.com/?q=a+%25zz+b~%2A', 'x.com', 'http://x.com/'),
    ('http://x.com/?A=1&a=2&ref', 'http://x.com/?A=1&a=2', 'x.com', 'http://x.com/'),
    ('http://x.com/?a==b', 'http://x.com/?a=%3Db', 'x.com', 'http://x.com/'),
    ('http://x.com/?=v', 'http://x.com/?=v', 'x.com', 'http://x.com/'),
    ('http://x.com/?a=1;b=2', 'http://x.com/?a=1%3Bb%3D2', 'x.com', 'http://x.com/'),
    ('http://x.com/A;x/B;p=1?z=1', 'http://x.com/a;x/b?z=1', 'x.com', 'http://x.com/A;x/B'),
    ('http://x.com/?%75tm_source=1&k=1', 'http://x.com/?k=1', 'x.com', 'http://x.com/'),
    ('javascript:void(0)', 'javascript:void(0)', '', 'javascript://void(0)'),
    ('#frag', '/', '', '://'),
    ('?q=1', '/?q=1', '', '://'),
    ('', '/', '', '://'),
    ('  http://x.com/a  ', 'http://x.com/a  ', 'x.com', 'http://x.com/a  '),
    ('http://x.\tcom/a\nb', 'http://x.com/ab', 'x.com', 'http://x.com/ab'),
    ('http://[::1]:8080/a', 'http://[::1]:8080/a', '[', 'http://[::1]:8080/a'),
    ('http://[abc]/', None, None, 'http://[abc]/'),
    ('ftp://x.com/a;type=i', 'ftp://x.com/a', 'x.com', 'ftp://x.com/a'),
    ('foo://h/a;b', 'foo://h/a;b', 'h', 'foo://h/a;b'),
    ('http://x.com/a%2Fb?x=%2B&y=+', 'http://x.com/a%2fb?x=%2B&y=+', 'x.com', 'http://x.com/a%2Fb'),
    ('https://m.example.com/', 'https://m.example.com/', 'm.example.com', 'https://m.example.com/'),
    ('http://www./x', 'http:///x', '', 'http://www./x'),
]

#: Canonical URL and its dedup pass (second query pass; scheme and authority always spelt out).
DEDUP_PASS = [
    ('www.x.com/a', '://www.x.com/a'),
    ('mailto:a@b.c', 'mailto://a@b.c'),
    ('//h/p', '://h/p'),
    ('http://h/a?x=a+b&%C3%A9=%C3%BC', 'http://h/a?x=a+b&%C3%A9=%C3%BC'),
    ('http://x.com/?a=1&a=0&b=2', 'http://x.com/?a=1&a=0&b=2'),
    ('http://x.com/?q=a+%25zz+b~%2A', 'http://x.com/?q=a+%25zz+b~%2A'),
    ('http://x.com/?A=1&a=2', 'http://x.com/?A=1&a=2'),
    ('http://x.com/?a=%3Db', 'http://x.com/?a=%3Db'),
    ('http://x.com/?=v', 'http://x.com/?=v'),
    ('http://x.com/?a=1%3Bb%3D2', 'http://x.com/?a=1%3Bb%3D2'),
    ('http://x.com/a;x/b?z=1', 'http://x.com/a;x/b?z=1'),
    ('http://x.com/?k=1', 'http://x.com/?k=1'),
    ('javascript:void(0)', 'javascript://void(0)'),
    ('/', ':///'),
    ('/?q=1', ':///?q=1'),
    ('ftp://x.com/a', 'ftp://x.com/a'),
    ('foo://h/a;b', 'foo://h/a;b'),
    ('http://x.com/a%2fb?x=%2B&y=+', 'http://x.com/a%2fb?x=%2B&y=+'),
    ('http://x.com/?ref=1&b=&a', 'http://x.com/?a=&b='),
]

#: URL and dedup key text.
DEDUP_KEYS = {
    'https://example.com/page': 'https://example.com/page',
    'https://www.example.com/page/': 'https://example.com/page',
    'http://a.org/x?b=1&a=2': 'http://a.org/x?a=2&b=1',
    'http://a.org/x?a=2&b=1&utm_source=z': 'http://a.org/x?a=2&b=1',
    'http://[::1': None,
    'HTTP://A.ORG/X?A=2': 'http://a.org/x?A=2',
    'mailto:q@r.s': 'mailto://q@r.s',
    'https://m.site.com/p#f': 'https://m.site.com/p',
    'https://site.com/p': 'https://site.com/p',
    'http://a.org:80/x?a=2&b=1': 'http://a.org/x?a=2&b=1',
}
