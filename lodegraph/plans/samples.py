"""Small sources of each language, for the queries that parse code, and the symbols that they hold."""

SOURCES = {
    "shop/cart.py": '"""Carts."""\nimport os\nfrom decimal import Decimal as D\n\nRATE: float = 0.2\n\n\nclass Cart(Base):\n    """Holds items."""\n\n    limit = 9\n\n    def __init__(self, items):\n        self.items = items\n\n    async def total(self, tax=True) -> D:\n        """Sum."""\n        if tax and self.items or RATE:\n            return add(self.items)\n        return sum(x for x in self.items)\n\n\ndef add(items):\n    for i in items:\n        os.getenv(i)\n    return Cart(items)\n',
    "shop/broken.py": "def fine():\n    return 1\n\ndef bad(:\n    pass\n\nLAST = fine()\n",
    "web/app.ts": "import { get as fetchIt, put } from './net';\nimport * as util from 'util';\nimport React from 'react';\n\n/** Shapes. */\nexport interface Shape { area(): number }\nexport type Id = string | number;\n\nexport class View extends Base {\n  title = 'x';\n  constructor(a) { super(a); this.draw(a); }\n  async draw(b: Id): Promise<void> { if (b) { await fetchIt(b); } }\n}\n\nexport const go = async (x) => { return x ? put(x) : util.y(x); };\nfunction plain(a, b) { for (const q of a) { go(q); } }\nlet n = 3;\n",
    "srv/main.go": 'package main\n\nimport (\n\t"fmt"\n\tlog "example.com/x/log"\n)\n\ntype Server struct {\n\tport int\n}\n\ntype Names []string\n\nconst Max = 3\n\nvar count int\n\nfunc (s *Server) Run(n int) (int, error) {\n\tfor i := range n {\n\t\tif i > Max && n > 0 {\n\t\t\tlog.Print(i)\n\t\t}\n\t}\n\treturn helper(n), nil\n}\n\nfunc helper(n int) int {\n\tswitch n {\n\tcase 1:\n\t\treturn 2\n\tdefault:\n\t\tfmt.Println(n)\n\t}\n\treturn n\n}\n',
    "notes/readme.md": "# Notes\n",
}

#: What reading those sources by hand gives, in order: path, name, kind, first and last line, signature, public, async, complexity, extra.
EXPECTED = (
    ('shop/broken.py', 'fine', 'function', 1, 2, 'fine()', True, False, 1.0, None),
    ('shop/broken.py', 'LAST', 'variable', 7, 7, None, True, False, 0.0, '{"is_constant": true, "scope": "module"}'),
    ('shop/cart.py', 'os', 'import', 2, 2, None, True, False, 0.0, None),
    ('shop/cart.py', 'D', 'import', 3, 3, None, True, False, 0.0, None),
    ('shop/cart.py', 'RATE', 'variable', 5, 5, 'float', True, False, 0.0, '{"is_constant": true, "scope": "module"}'),
    ('shop/cart.py', 'Cart', 'class', 8, 20, None, True, False, 0.0, '{"base_classes": ["Base"], "is_abstract": false}'),
    ('shop/cart.py', 'limit', 'variable', 11, 11, None, True, False, 0.0, '{"is_constant": false, "scope": "class"}'),
    ('shop/cart.py', '__init__', 'function', 13, 14, '__init__(self, items)', True, False, 1.0, None),
    ('shop/cart.py', 'total', 'function', 16, 20, 'total(self, tax=True) -> D', True, True, 4.0, None),
    ('shop/cart.py', 'add', 'function', 23, 26, 'add(items)', True, False, 2.0, None),
    ('srv/main.go', 'fmt', 'import', 3, 3, None, True, False, 0.0, None),
    ('srv/main.go', 'log', 'import', 3, 3, None, True, False, 0.0, None),
    ('srv/main.go', 'Server', 'class', 8, 10, 'type Server struct_type', True, False, 0.0, '{"go_type_kind": "struct_type"}'),
    ('srv/main.go', 'Names', 'type', 12, 12, 'type Names slice_type', True, False, 0.0, '{"go_type_kind": "slice_type"}'),
    ('srv/main.go', 'Max', 'variable', 14, 14, None, True, False, 0.0, '{"is_constant": true}'),
    ('srv/main.go', 'count', 'variable', 16, 16, None, False, False, 0.0, '{"is_constant": false}'),
    ('srv/main.go', 'Run', 'function', 18, 25, '(Server) Run(n int) (int, error)', True, False, 4.0, None),
    ('srv/main.go', 'helper', 'function', 27, 35, 'helper(n int) int', False, False, 3.0, None),
    ('web/app.ts', 'fetchIt', 'import', 1, 1, None, True, False, 0.0, None),
    ('web/app.ts', 'put', 'import', 1, 1, None, True, False, 0.0, None),
    ('web/app.ts', 'util', 'import', 2, 2, None, True, False, 0.0, None),
    ('web/app.ts', 'React', 'import', 3, 3, None, True, False, 0.0, None),
    ('web/app.ts', 'Shape', 'type', 6, 6, 'interface Shape', True, False, 0.0, None),
    ('web/app.ts', 'Id', 'type', 7, 7, 'type Id = string | number;', True, False, 0.0, None),
    ('web/app.ts', 'View', 'class', 9, 13, None, True, False, 0.0, None),
    ('web/app.ts', 'title', 'variable', 10, 10, None, True, False, 0.0, None),
    ('web/app.ts', 'constructor', 'function', 11, 11, 'constructor(a)', True, False, 1.0, None),
    ('web/app.ts', 'draw', 'function', 12, 12, 'draw(b: Id)', True, True, 2.0, None),
    ('web/app.ts', 'go', 'function', 15, 15, 'go(x)', True, True, 2.0, None),
    ('web/app.ts', 'plain', 'function', 16, 16, 'plain(a, b)', True, False, 2.0, None),
    ('web/app.ts', 'n', 'variable', 17, 17, None, True, False, 0.0, '{"is_constant": false}'),
)
