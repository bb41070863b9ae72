"""Token shapes and grammars of the languages whose files are checked: rules in the notation of gll.Grammar."""

from __future__ import annotations

import re
from collections.abc import Callable

from codeloom.functions import lexing
from codeloom.llm.gll import DEEPEST, GROUPS, ROOM, Dialect, Grammar, Kinds, outside_angles
from codeloom.functions.lexing import END, ERROR, FORMATTED, REGEX, SUB, TEMPLATE

BRACE = f"[{chr(GROUPS['{'])}-{chr(GROUPS['{'] + ROOM)}]"
PAREN = f"[{chr(GROUPS['('])}-{chr(GROUPS['('] + ROOM)}]"
SOFT = "⏎"  # a line end where a statement may end

# --------------------------------------------------------------------------- building blocks


def _grammar(rules: str, classes: dict[str, str], names: str = "") -> Grammar:
    """classes: the character of each class of tokens; names: words of the grammar that may also be names."""
    tokens = sorted(set(re.findall(r"'([^']+)'", rules)))
    chars = {t: t if len(t) == 1 and not t.isalnum() else chr(0x100 + i) for i, t in enumerate(tokens)}
    chars |= {f"\x01{c}": char for c, char in classes.items()}
    members = {c: {f"\x01{c}"} for c in classes}
    members["NAME"] = members["NAME"] | {n for n in names.split() if n in chars}
    members["WORD"] = members["NAME"] | {t for t in tokens if t[0].isalpha()}
    return Grammar(rules, members, chars)


def _fixed(g: Grammar) -> dict[str, str]:
    return {t: c for t, c in g.chars.items() if t[0] != "\x01"} | {b: b for b in f"()[]{{}}{SUB}{END}"}


def _of(g: Grammar, words: str) -> str:
    """A character class of tokens, for patterns on shapes."""
    return "".join(re.escape(g.chars[w]) for w in words.split() if w in g.chars)


def _segments(rule: str, cut: re.Pattern[str]) -> tuple[Callable[[Dialect, str], bool]]:
    """Statement lists: cut where a statement must end, and each part recognised by itself."""

    def plays(d: Dialect, text: str) -> bool:
        parts = cut.split(text)
        accepts = d.grammar.accepts
        last = parts.pop()
        return all(accepts(rule, p) for p in parts) and (not last or accepts(rule, last) or accepts(rule, last + ";"))

    return (plays,)


def _other(name: str, number: str, string: str, more: Callable[[str], str] | None = None) -> Callable[[str], str]:
    def kind(t: str) -> str:
        c = t[0]
        if c.isalpha() or c in "_$":
            return name
        if c.isdigit() or (c == "." and len(t) > 1):
            return number
        if c in "\"'":
            return string if len(t) > 1 and t[-1] == c else ERROR
        if t[:2] == "//" or t[:2] == "/*":
            return ("\n" if "\n" in t else "") if len(t) < 4 or t[1] == "/" or t[-2:] == "*/" else ERROR
        return more(t) if more else ERROR

    return kind


#: The line that names a script's interpreter.
_INTERPRETER = re.compile(r"\A#![^\n\r\u2028\u2029]*")


class Language:
    """Reads content into a shape and asks which dialects accept it: they share the shape, the groups and the stack, and any of them will do."""

    def __init__(self, tokens: Callable[[str], list[str]], parts: tuple[Dialect, Kinds, Callable[[str], str], Callable[[Dialect, str], bool]], interpreter: bool = False):
        self.tokens, self.interpreter = tokens, interpreter
        self.dialect, self.kinds, self.lines, self.top = parts

    def accepts(self, content: str, deepest: int | None = DEEPEST) -> bool:
        content = content.removeprefix("\ufeff")
        if self.interpreter:
            content = _INTERPRETER.sub("", content)
        shape = "".join(map(self.kinds.__getitem__, self.tokens(content)))
        if ERROR in shape:
            return False
        reduced = self.dialect.reduce(self.lines(shape), deepest)
        return reduced is not None and self.top(self.dialect, self.dialect.clean(reduced))


# --------------------------------------------------------------------------- JavaScript and TypeScript

_JS = """
Stmts = Stmt*
Stmt = <Block> | ';' | Var ';' | SExpr ';' | 'if' <Paren> Stmt ('else' Stmt)? | 'for' 'await'? <ForHead> Stmt | 'while' <Paren> Stmt
  | 'do' Stmt 'while' <Paren> ';'? | 'return' Expr? ';' | 'break' NAME? ';' | 'continue' NAME? ';' | 'throw' Expr ';'
  | 'try' <Block> ('catch' <Paren>? <Block> ('finally' <Block>)? | 'finally' <Block>) | 'switch' <Paren> <Switch>
  | 'with' <Paren> Stmt | NAME ':' Stmt | 'debugger' ';' | Func | ClassD | More
Cases = (('case' Expr | 'default') ':' | Stmt)*
Items = (Import | Export | Top)*
ScriptItems = (Top | 'with' <Paren> Top)*
Top = <Block> | ';' | Var ';' | SExpr ';' | 'if' <Paren> Stmt ('else' Stmt)? | 'for' 'await'? <ForHead> Stmt | 'while' <Paren> Stmt
  | 'do' Stmt 'while' <Paren> ';'? | 'throw' Expr ';' | 'try' <Block> ('catch' <Paren>? <Block> ('finally' <Block>)? | 'finally' <Block>)
  | 'switch' <Paren> <Switch> | NAME ':' Top | 'debugger' ';' | Func | ClassD | More
Import = 'import' STR Attr? ';' | 'import' 'type'? Clause 'from' STR Attr? ';' | ImportMore
Attr = 'with' <Object>
Clause = NAME (',' (<Specs> | '*' 'as' NAME))? | <Specs> | '*' 'as' NAME
Export = 'export' (Var ';' | Func | ClassD | <Specs> ('from' STR Attr?)? ';' | '*' ('as' WORD)? 'from' STR Attr? ';' | More | ExportMore)
  | 'export' 'default' (FuncE | Deco* ClassE | Assign ';' | DefaultMore)
Spec = 'type'? (WORD | STR) ('as' (WORD | STR))?
Var = ('const' | 'let' | 'var' | 'using') Decl (',' Decl)*
Decl = Binding DeclAnn ('=' Assign)?
Binding = NAME | <ArrPat> | <ObjPat>
ArrP = (Binding ('=' Assign)?)? | '...' Binding
ObjP = NAME ('=' Assign)? | Key ':' Binding ('=' Assign)? | '...' Binding
Param = Deco* ParamMod* Binding '?'? Ann ('=' Assign)? | Deco* '...' Binding Ann | 'this' Ann
ForHead = (Var | Expr)? ';' Expr? ';' Expr? | (('const' | 'let' | 'var' | 'using') Binding | Lhs) ('of' Assign | 'in' Expr)
Func = 'async'? 'function' '*'? NAME Gen <Params> Ret Body
FuncE = 'async'? 'function' '*'? NAME? Gen <Params> Ret <Block>
ClassD = Deco* ClassMod 'class' NAME Gen Heritage <ClassBody>
ClassE = ClassMod 'class' NAME? Gen Heritage <ClassBody>
Deco = '@' (NAME ('.' WORD)* <Args>? | <Paren>)
Members = Member*
Member = ';' | 'static' <Block> | Deco* MemberMod* ('async' | 'get' | 'set' | 'async'? '*')? MKey Opt Gen <Params> Ret Body | Deco* MemberMod* MKey FieldOpt Ann ('=' Assign)? ';' | MemberMore
MKey = Key | '#' WORD
Key = WORD | STR | NUM | <Index>
Prop = Key ':' Assign | NAME ('=' Assign)? | '...' Assign | ('async' | 'get' | 'set' | 'async'? '*')? Key Gen <Params> Ret <Block>
Arg = '...'? Assign
Elem = Arg?
Expr = Assign (',' Assign)*
Assign = Cond | Lhs AssignOp Assign | Arrow | 'yield' '*'? Assign? | GenericArrow
Arrow = 'async'? (NAME | <Params> Ret) '=>' (Assign | <Block>)
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
Cond = Bin ('?' Assign ':' Assign)?
Bin = Un (BinOp Un | As)*
BinOp = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof'
Un = (PreOp | Assertion)* Lhs ('++' | '--')?
PreOp = '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await'
Lhs = Prim Suffix*
Suffix = '.' WORD | '.' '#' WORD | '?.' (WORD | <Args> | <Index> | '#' WORD) | <Index> | <Args> | Templ | TypeSuffix
Templ = TEMPLATE <Sub>*
Prim = SPrim | <Object> | FuncE | ClassE
SPrim = NAME | NUM | STR | Templ | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | <Paren> | <Array> | 'new' Lhs | 'new' '.' WORD | 'import' <Args> | 'import' '.' WORD | '#' WORD
SExpr = SAssign (',' Assign)*
SAssign = SCond | SLhs AssignOp Assign | Arrow | 'yield' '*'? Assign?
SCond = SBin ('?' Assign ':' Assign)?
SBin = SUn (BinOp Un | As)*
SUn = (PreOp | Assertion) (PreOp | Assertion)* Lhs ('++' | '--')? | SLhs ('++' | '--')?
SLhs = SPrim Suffix*
"""
_JS_ONLY = """
More = 'let' ERR
ImportMore = 'let' ERR
ExportMore = 'let' ERR
DefaultMore = 'let' ERR
MemberMore = 'let' ERR
GenericArrow = 'let' ERR
DeclAnn =
Ann =
Gen =
Ret =
Opt =
FieldOpt =
Body = <Block>
ParamMod = 'let' ERR
ClassMod =
MemberMod = 'static' | 'accessor'
Heritage = ('extends' Lhs)?
As = 'let' ERR
TypeSuffix = 'let' ERR
Assertion = 'let' ERR
"""
_TS_ONLY = """
More = 'declare' (Var ';' | Func | ClassD | More | 'global' <Block> | 'module' STR (<Module> | ';')) | 'interface' NAME Gen ('extends' Ref (',' Ref)*)? <TypeBody>
  | 'type' NAME Gen '=' Type ';' | 'const'? 'enum' NAME <EnumBody> | ('namespace' | 'module') NAME ('.' NAME)* <Module>
ImportMore = 'import' 'type'? NAME '=' ('require' <Args> | NAME ('.' NAME)*) ';'
ExportMore = 'type' <Specs> ('from' STR)? ';' | '=' Expr ';' | 'import' NAME '=' ('require' <Args> | NAME ('.' NAME)*) ';' | 'as' 'namespace' NAME ';' | 'type' '*' ('as' WORD)? 'from' STR ';'
DefaultMore = 'interface' NAME Gen ('extends' Ref (',' Ref)*)? <TypeBody> | 'abstract' 'class' NAME? Gen Heritage <ClassBody>
MemberMore = MemberMod* <IndexSig> Ann ';'
GenericArrow = 'async'? GenP <Params> Ret '=>' (Assign | <Block>)
DeclAnn = ('!'? ':' Type)?
Ann = (':' Type)?
Gen = GenP?
GenP = '<' GenOne (',' GenOne)* ','? '>'
GenOne = ('const' | 'in' | 'out')* NAME ('extends' Type)? ('=' Type)?
Ret = (':' (Type | 'asserts'? (NAME | 'this') ('is' Type)?))?
Opt = '?'?
FieldOpt = ('?' | '!')?
Body = <Block> | ';'
ParamMod = 'public' | 'private' | 'protected' | 'readonly' | 'override'
ClassMod = 'abstract'?
MemberMod = 'static' | 'accessor' | 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare'
Heritage = ('extends' Lhs TypeArgs?)? ('implements' Ref (',' Ref)*)?
As = ('as' | 'satisfies') (Type | 'const')
TypeSuffix = '!' | TypeArgs <Args> | TypeArgs Templ
TypeArgs = '<' Type (',' Type)* '>'
Assertion = '<' (Type | 'const') '>'
Ref = NAME ('.' WORD)* TypeArgs?
Type = Union | Union 'extends' Union '?' Type ':' Type | FuncType | 'asserts'? (NAME | 'this') 'is' Type
FuncType = 'abstract'? 'new'? Gen <Params> '=>' (Type | 'asserts' NAME)
Union = ('|' | '&')? TypeUn (('|' | '&') (TypeUn | FuncType))*
TypeUn = ('keyof' | 'unique' | 'readonly' | 'infer')* TypePost
TypePost = TypePrim (<EmptyIdx> | <TypeIdx>)*
TypePrim = Ref | 'void' | 'null' | 'this' | 'true' | 'false' | STR | '-'? NUM | TEMPLATE <TypeSub>* | <TypeParen> | <TypeBody> | <Mapped> | <Tuple> | 'typeof' NAME ('.' WORD)* TypeArgs? | 'import' <Args> ('.' WORD)* TypeArgs?
TMembers = TMember*
TMember = (';' | ',') | TMod* Key '?'? Ann (';' | ',') | TMod* ('get' | 'set')? Key '?'? Gen <Params> Ret (';' | ',') | TMod* <IndexSig> Ann (';' | ',') | 'new'? Gen <Params> Ret (';' | ',')
TMod = 'readonly'
Mapped = (('+' | '-')? 'readonly')? <MapKey> (('+' | '-')? '?')? ':' Type ';'?
MapKey = NAME 'in' Type ('as' Type)?
IndexSig = NAME ':' Type
TupleEl = '...'? Type '?'? | '...'? WORD '?'? ':' Type
EnumEl = (NAME | STR) ('=' Assign)?
Empty =
"""
_JS_NAMES = "async get set of as from static await yield let type using accessor declare global module interface enum namespace require abstract readonly public private protected override implements is asserts keyof unique infer satisfies out"


def _script(ts: bool) -> tuple[Dialect, Kinds, Callable[[str], str], Callable[[Dialect, str], bool]]:
    classes = {"NAME": "n", "NUM": "1", "STR": "s", "TEMPLATE": "t", "REGEX": "r", "ERR": "\x02"}
    g = _grammar(_JS + (_TS_ONLY if ts else _JS_ONLY), classes, _JS_NAMES)
    words = "".join(c for t, c in g.chars.items() if t[0].isalpha())
    apart = _of(g, "else catch finally while from as of in instanceof satisfies extends implements is")
    starts = "".join(c for c in "n1sr@#" + words if c not in apart)
    ends = "n1str" + _of(g, "this super null true false return break continue debugger ++ -- " + _JS_NAMES)
    soft = re.compile(rf"([{ends})\]}}{END}])\n+(?=[{re.escape(starts)}!~]|{re.escape(g.chars['++'])}|{re.escape(g.chars['--'])})")
    # before else and the like, a line end may only end a statement that isn't a block
    kept = re.compile(rf"([{ends})\]{END}])\n+(?=[{_of(g, 'else while')}])")
    heads = re.compile(rf"([{_of(g, 'if while for with')}]{_of(g, 'await')}?{PAREN}|@(?:n\.)*n{PAREN}?){SOFT}")
    cut = re.compile(rf"(?<=;)(?![{_of(g, 'else')}])|(?<={BRACE})(?=[{re.escape(starts)}])")

    def lines(shape: str) -> str:
        return kept.sub(rf"\1{SOFT}", soft.sub(rf"\1{SOFT}", shape)).replace("\n", "")

    def clean(text: str) -> str:
        return heads.sub(r"\1", text).replace(SOFT, ";") if SOFT in text else text

    kinds = Kinds(_fixed(g) | {TEMPLATE: "t", REGEX: "r", '""': "s", "\n": "\n"}, _other("n", "1", "s"))
    roles = {
        "{": {"Block": _segments("Stmts", cut), "Switch": _segments("Cases", cut), "Object": ("Prop", ","), "ClassBody": _segments("Members", cut), "ObjPat": ("ObjP", ","), "Specs": ("Spec", ",")},
        "(": {"Args": ("Arg", ","), "Params": ("Param", ","), "ForHead": ("ForHead",)},
        "[": {"Array": ("Elem", ","), "ArrPat": ("ArrP", ",")},
        SUB: {"Sub": ("Expr",)},
    }
    each = lambda s: all(g.accepts("Assign", p) for p in s.split(",")) or ("<" in s and g.accepts("Expr", s))
    roles["("]["Paren"] = (lambda d, s: each(s) or g.accepts("Decl", s),)  # with the name of a catch
    roles["["]["Index"] = (lambda d, s: each(s),)
    if ts:
        roles["{"] |= {"TypeBody": _segments("TMembers", cut), "EnumBody": ("EnumEl", ","), "Module": _segments("Items", cut), "Mapped": ("Mapped",)}
        roles["("] |= {"TypeParen": ("Type",)}
        roles[SUB] |= {"TypeSub": ("Type",)}
        roles["["] |= {"EmptyIdx": (lambda d, s: s == "",), "TypeIdx": ("Type",), "IndexSig": ("IndexSig",), "MapKey": ("MapKey",), "Tuple": ("TupleEl", ",")}
    dialect = Dialect("typescript" if ts else "javascript", g, roles, clean)

    def top(d: Dialect, text: str) -> bool:
        """Statements at the top of a script, or of a module: both are tried on each part at once."""
        alive = frozenset(("ScriptItems", "Items"))
        parts = cut.split(text)
        last = parts.pop()
        for p in parts:
            alive &= g.together(("Items", "ScriptItems"), p)
            if not alive:
                return False
        return not last or bool(alive & (g.together(("Items", "ScriptItems"), last) | g.together(("Items", "ScriptItems"), last + ";")))

    return dialect, kinds, lines, top


# --------------------------------------------------------------------------- Go

_GO = """
Package = 'package' NAME
Item = 'import' (ImportOne | <Imports>) | Decl | FuncDecl
ImportOne = (NAME | '.')? STR
Decl = 'var' (VarSpec | <Vars>) | 'const' (ConstSpec | <Consts>) | 'type' (TypeSpec | <Types>)
VarSpec = Names (Type ('=' Exprs)? | '=' Exprs)
ConstSpec = Names (Type? '=' Exprs)?
TypeSpec = NAME <TypeParams>? '='? Type
FuncDecl = 'func' <Params>? NAME <TypeParams>? <Params> Result? <Block>?
Result = Type | <Params>
Names = NAME (',' NAME)*
Stmt = (One? ';')* One?
One = Simple | Decl | 'if' Head If | 'for' For <Block> | 'switch' (Simple? ';')? (Expr | NAME ':=' Expr)? <Cases> | 'select' <Cases> | 'return' Exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough'
  | 'defer' Expr | 'go' Expr | NAME ':' One? | <Block>
If = <Block> ('else' ('if' Head If | <Block>))?
Head = (Simple? ';')? Expr
For = Expr? | Simple? ';' Expr? ';' Simple? | (Exprs (':=' | '='))? 'range' Expr
CaseSeg = (('case' (Exprs | Types | Simple) | 'default') ':')* Stmt
Types = Type (',' Type)*
Simple = Exprs | Exprs (':=' | '=') Exprs | Expr AssignOp Expr | Expr ('++' | '--') | Expr '<-' Expr
AssignOp = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
Exprs = Expr (',' Expr)*
Expr = Un (BinOp Un)*
BinOp = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '>' | '>='
Un = ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~')* Prim Suffix*
Prim = NAME | NUM | STR | CHAR | <Paren> | 'func' <Params> Result? <Block> | LitType <Lit> | ConvType <Args>
LitType = Named | <ArrLen> Type | 'map' <TypeIdx> Type | 'struct' <Fields>
ConvType = <ArrLen> Type | 'map' <TypeIdx> Type | 'chan' Type | 'func' <Params> Result? | 'interface' <Iface> | <Paren>
Named = NAME ('.' NAME)? <TypeIdx>?
Suffix = '.' NAME | '.' <TypeSel> | <Index> | <TypeIdx> | <Args> | <Lit>
Type = Named | '*' Type | <ArrLen> Type | 'map' <TypeIdx> Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' <Params> Result? | 'struct' <Fields> | 'interface' <Iface> | <TypeParen>
Param = Type | NAME Type | NAME? '...' Type
Arg = Expr '...'? | Type
Index = Expr | Expr? ':' Expr? | Expr? ':' Expr ':' Expr
Element = (Value ':')? Value
Value = Expr | <Lit>
Field = (Names Type | '*'? Named) STR?
IfaceEl = NAME <Params> Result? | '~'? Type ('|' '~'? Type)*
TypeParam = Names? '~'? Type ('|' '~'? Type)*
ArrLen = (Expr | '...')?
TypeSel = 'type' | Type
Empty =
"""


def _go() -> tuple[Dialect, Kinds, Callable[[str], str], Callable[[Dialect, str], bool]]:
    g = _grammar(_GO, {"NAME": "n", "NUM": "1", "STR": "s", "CHAR": "c"})
    auto = re.compile(rf"([n1sc{_of(g, 'break continue fallthrough return ++ --')})\]}}])\n+")

    def more(t: str) -> str:
        return "s" if t[0] == "`" and len(t) > 1 else "\n" if t == "\n" else ERROR

    base = _other("n", "1", "s", more)
    kinds = Kinds(_fixed(g), lambda t: ("c" if len(t) > 2 and t[-1] == "'" else ERROR) if t[0] == "'" else base(t))

    def lines(shape: str) -> str:
        return auto.sub(rf"\1{SOFT}", shape + "\n").replace("\n", "")

    def each(rule: str) -> tuple[Callable[[Dialect, str], bool]]:
        return (lambda d, s: all(p == "" or g.accepts(rule, p) for p in s.split(SOFT)),)

    def listed(rule: str) -> tuple[Callable[[Dialect, str], bool]]:
        """Elements between commas; a line end stands only after the last, where a comma must be."""
        return (lambda d, s: SOFT not in s and (not s or all(g.accepts(rule, p) for p in s.removesuffix(",").split(","))),)

    def either(rule: str) -> tuple[Callable[[Dialect, str], bool]]:
        """Declarations in brackets, apart by line ends or semicolons."""
        return (lambda d, s: all(p == "" or g.accepts(rule, p) for p in re.split(f"[;{SOFT}]", s)),)

    roles = {
        "{": {"Block": each("Stmt"), "Cases": each("CaseSeg"), "Lit": listed("Element"), "Fields": either("Field"), "Iface": either("IfaceEl")},
        "(": {"Paren": (lambda d, s: g.accepts("Expr", s) or g.accepts("Type", s),), "Args": listed("Arg"), "Params": listed("Param"), "TypeSel": ("TypeSel",), "TypeParen": ("Type",), "Imports": either("ImportOne"), "Vars": either("VarSpec"), "Consts": either("ConstSpec"), "Types": either("TypeSpec")},
        "[": {"Index": ("Index",), "TypeIdx": ("Type", ","), "TypeParams": ("TypeParam", ","), "ArrLen": ("ArrLen",)},
    }
    dialect = Dialect("go", g, roles)

    def top(d: Dialect, s: str) -> bool:
        parts = [p for p in re.split(f"[;{SOFT}]", s) if p]
        return bool(parts) and g.accepts("Package", parts[0]) and all(g.accepts("Item", p) for p in parts[1:])

    return dialect, kinds, lines, top


# --------------------------------------------------------------------------- Java

_JAVA = """
Package = Anno* 'package' QName ';'
Import = 'import' 'static'? QName ('.' '*')? ';'
TypeItem = TypeDecl | ';'
ModuleItem = Anno* 'open'? 'module' QName <ModuleBody>
QName = NAME ('.' NAME)*
Mods = (Mod | Anno)*
Mod = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
Anno = '@' QName <AnnoArgs>?
AnnoArg = AnnoValue | NAME '=' AnnoValue
AnnoValue = Expr | <ArrInit> | Anno
TypeDecl = Mods ('class' NAME Gen ('extends' Type)? ('implements' Types)? ('permits' Types)? <ClassBody> | 'interface' NAME Gen ('extends' Types)? ('permits' Types)? <ClassBody>
  | 'enum' NAME ('implements' Types)? <EnumBody> | 'record' NAME Gen <Params> ('implements' Types)? <ClassBody> | '@' 'interface' NAME <ClassBody>)
Types = Type (',' Type)*
Members = Member*
Member = TypeDecl | Mods GenP? Anno* (Type | 'void') NAME <Params> <Empty>* Throws (<Block> | ';' | 'default' AnnoValue ';') | Mods GenP? NAME <Params> Throws <Block> | Mods NAME <Block> | Mods Type Vars ';' | 'static'? <Block> | ';'
Throws = ('throws' Types)?
Gen = GenP?
GenP = '<' GenOne (',' GenOne)* '>'
GenOne = Anno* NAME ('extends' Type ('&' Type)*)?
Type = Anno* (Basic | Class) (Anno* <Empty>)*
Basic = 'int' | 'long' | 'double' | 'float' | 'boolean' | 'char' | 'byte' | 'short'
Class = NAME TypeArgs? ('.' Anno* NAME TypeArgs?)*
TypeArgs = '<' '>' | '<' TypeArg (',' TypeArg)* '>'
TypeArg = Type | Anno* '?' (('extends' | 'super') Type)?
Vars = VarOne (',' VarOne)*
VarOne = NAME <Empty>* ('=' (Expr | <ArrInit>))?
Param = ('final' | Anno)* Type (Anno* '...')? (NAME <Empty>* | 'this' | NAME '.' 'this')
EnumBody = (EnumOne (',' EnumOne)* ','?)? (';' Members)?
EnumOne = Anno* NAME <Args>? <ClassBody>?
Stmts = Stmt*
Stmt = <Block> | ';' | ('final' | Anno)* Type Vars ';' | SExpr ';' | 'if' <Paren> Stmt ('else' Stmt)? | 'while' <Paren> Stmt | 'do' Stmt 'while' <Paren> ';' | 'for' <ForHead> Stmt | 'return' Expr? ';' | 'throw' Expr ';'
  | 'break' NAME? ';' | 'continue' NAME? ';' | 'yield' Expr ';' | 'assert' Expr (':' Expr)? ';' | 'synchronized' <Paren> <Block> | NAME ':' Stmt | TypeDecl | Switch
  | 'try' <Block> (Catch Catch* ('finally' <Block>)? | 'finally' <Block>) | 'try' <Resources> <Block> Catch* ('finally' <Block>)?
Catch = 'catch' <CatchParam> <Block>
CatchParam = ('final' | Anno)* Type ('|' Type)* NAME
Resource = ('final' | Anno)* Type NAME '=' Expr | Post
Switch = 'switch' <Paren> <Cases>
Cases = (('case' Label (',' Label)* ('when' Expr)? | 'default') (':' | '->' (Expr ';' | <Block> | 'throw' Expr ';')) | Stmt)*
Label = Cond | 'default' | Pattern
Pattern = ('final' | Anno)* Type NAME | Type <Patterns> NAME?
PatternOne = Pattern
ForHead = (('final' | Anno)* Type Vars | Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)? | ('final' | Anno)* Type NAME ':' Expr
SExpr = Post AssignOp Expr | ('++' | '--') Un | Post ('++' | '--') | Call | 'new' Creator Suffix*
Call = Prim Suffix* <Args>
Expr = Cond | Post AssignOp Expr | Lambda
Lambda = (NAME | <Names> | <Params>) '->' (Expr | <Block>)
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
Cond = Bin ('?' Expr ':' (Cond | Lambda))?
Bin = Un (BinOp Un | 'instanceof' 'final'? (Type | Pattern))*
BinOp = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>'
Un = ('+' | '-' | '++' | '--' | '!' | '~') Un | <Cast> (Un | Lambda) | Post ('++' | '--')?
Post = Prim Suffix*
Prim = NAME | NUM | STR | CHAR | 'this' | 'super' | 'null' | 'true' | 'false' | <Paren> | 'new' Creator | Type '::' TypeArgs? (NAME | 'new') | Type '.' 'class' | 'void' '.' 'class' | Switch
Creator = TypeArgs? Anno* (Class <Args> <ClassBody>? | (Basic | Class) (<Index>) <Index>* <Empty>* | Type <ArrInit>)
Suffix = '.' TypeArgs? NAME | '.' ('this' | 'class' | 'super') | '.' 'new' Creator | <Index> | <Args> | '::' TypeArgs? (NAME | 'new')
ArrEl = Expr | <ArrInit> | Anno
ModuleStmt = WORD WORD* QName (NAME Types)? (',' QName)* ';'
CastType = Type ('&' Type)*
"""
_JAVA_NAMES = "record sealed permits non yield when open module"


def _java() -> tuple[Dialect, Kinds, Callable[[str], str], Callable[[Dialect, str], bool]]:
    g = _grammar(_JAVA, {"NAME": "n", "NUM": "1", "STR": "s", "CHAR": "c"}, _JAVA_NAMES)
    words = "".join(c for t, c in g.chars.items() if t[0].isalpha())
    apart = _of(g, "else catch finally while instanceof")
    cut = re.compile(rf"(?<=;)|(?<={BRACE})(?=[{re.escape(''.join(c for c in 'n@' + words if c not in apart))}])")

    def more(t: str) -> str:
        return ERROR

    base = _other("n", "1", "s", more)
    kinds = Kinds(_fixed(g), lambda t: ("c" if len(t) > 2 and t[-1] == "'" else ERROR) if t[0] == "'" else base(t).replace("\n", ""))

    def strict(rule: str) -> tuple[Callable[[Dialect, str], bool]]:
        return (lambda d, s: all(p == "" or g.accepts(rule, p) for p in cut.split(s)),)

    def enum(d: Dialect, s: str) -> bool:
        names, _, rest = s.partition(";")
        return all(g.accepts("EnumOne", p) for p in names.removesuffix(",").split(",") if names) and all(p == "" or g.accepts("Members", p) for p in cut.split(rest))

    roles = {
        "{": {"Block": strict("Stmts"), "ClassBody": strict("Members"), "EnumBody": (enum,), "ArrInit": ("ArrEl", ","), "Cases": strict("Cases"), "ModuleBody": strict("ModuleStmt")},
        "(": {
            "Paren": ("Expr",), "Cast": ("CastType",), "Args": (lambda d, s: s == "" or all(g.accepts("Expr", p) for p in s.split(",")) or all(g.accepts("Expr", p) for p in outside_angles(s, ",")),), "Params": (lambda d, s: s == "" or all(g.accepts("Param", p) for p in outside_angles(s, ",")),),
            "Names": (lambda d, s: s == "" or all(p == "n" for p in s.split(",")),), "AnnoArgs": (lambda d, s: s == "" or all(g.accepts("AnnoArg", p) for p in s.split(",")),), "ForHead": ("ForHead",), "CatchParam": ("CatchParam",),
            "Resources": (lambda d, s: all(g.accepts("Resource", p) for p in s.removesuffix(";").split(";")),), "Patterns": ("PatternOne", ","),
        },
        "[": {"Index": ("Expr",), "Empty": (lambda d, s: s == "",)},
    }

    letters = {"Package": "p", "Import": "i", "TypeItem": "t", "ModuleItem": "m"}
    starts, order = tuple(letters), re.compile("p?i*t*|i*m")

    def top(d: Dialect, text: str) -> bool:
        """The parts of an ordinary file or of one that declares a module, tried on each part at once, in the order of either."""
        can = [g.together(starts, p) for p in cut.split(text) if p and p != ";"]
        return all(can) and order.fullmatch("".join(letters[min(c)] for c in can)) is not None

    return Dialect("java", g, roles), kinds, lambda s: s, top


# --------------------------------------------------------------------------- JSON

_JSON = """
Value = STR | NUM | 'true' | 'false' | 'null' | <Object> | <Array>
Member = STR ':' Value
"""


def _json() -> tuple[Dialect, Kinds, Callable[[str], str], Callable[[Dialect, str], bool]]:
    g = _grammar(_JSON, {"NAME": "n", "NUM": "1", "STR": "s"})
    fixed = _fixed(g) | {",": ","}
    kinds = Kinds(fixed, lambda t: "s" if t[0] == '"' and len(t) > 1 else "1" if t[0] in "-0123456789" and t != "-" else ERROR)

    def parts(rule: str) -> tuple[Callable[[Dialect, str], bool]]:
        return (lambda d, s: s == "" or all(g.accepts(rule, p) for p in set(s.split(","))),)

    return Dialect("json", g, {"{": {"Object": parts("Member")}, "[": {"Array": parts("Value")}, "(": {}}), kinds, lambda s: s, lambda d, s: g.accepts("Value", s)


# --------------------------------------------------------------------------- Python

_PY = """
Simple = Small (';' Small)* ';'?
Small = 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' (Test ('from' Test)?)? | 'global' Names | 'nonlocal' Names | 'del' DelTargets | 'assert' Test (',' Test)? | 'import' Mods | 'from' ('.' | '...')* From
  | Stars | (Targets '=')+ (Stars | Yield) | Single AugOp (Stars | Yield) | Single ':' Test ('=' (Stars | Yield))? | Yield | 'type' NAME <TypeParams>? '=' Test
From = Dotted 'import' ('*' | <Froms> | FromOne (',' FromOne)*) | 'import' ('*' | <Froms> | FromOne (',' FromOne)*)
FromOne = NAME ('as' NAME)?
Names = NAME (',' NAME)*
Mods = Dotted ('as' NAME)? (',' Dotted ('as' NAME)?)*
Dotted = NAME ('.' NAME)*
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Single = NAME | Power '.' NAME | Power <Index> | <TargetOne>
DelTargets = DelTarget (',' DelTarget)* ','?
DelTarget = NAME | Power '.' NAME | Power <Index> | <DelP> | <DelL>
Targets = '*'? Target (',' '*'? Target)* ','?
Target = NAME | Power '.' NAME | Power <Index> | <TargetP> | <TargetL>
StarTarget = '*'? Target
Stars = Star (',' Star)* ','?
Star = '*' Or | Test
StarNamed = '*' Or | Named
Named = NAME ':=' Test | Test
Test = Or ('if' Or 'else' Test)? | 'lambda' LParams? ':' Test
Or = Not (('and' | 'or') Not)*
Not = 'not'* Cmp
Cmp = Arith (CmpOp Arith)*
CmpOp = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?
Arith = Factor (('+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**') Factor)*
Factor = ('+' | '-' | '~')* 'await'? Power
Power = Atom Trail*
Trail = '.' NAME | <Args> | <Index>
Atom = NAME | NUM | Text Text* | BYTES BYTES* | 'None' | 'True' | 'False' | '...' | <Paren> | <List> | <Dict>
Text = STR | FORMATTED <Field>*
FieldOne = (Stars | Yield) '='? <Field>*
Yield = 'yield' ('from' Test | Stars)?
LN = NAME (',' NAME)*
LD = NAME '=' Test (',' NAME '=' Test)*
LPos = LN | LN ',' '/' | LN ',' '/' ',' LN | LN ',' LD | LN ',' '/' ',' LD | LN ',' '/' ',' LN ',' LD | LN ',' LD ',' '/' | LN ',' LD ',' '/' ',' LD | LD | LD ',' '/' | LD ',' '/' ',' LD
LK = NAME ('=' Test)?
LTail = '*' NAME (',' LK)* (',' '**' NAME)? | '*' (',' LK)+ (',' '**' NAME)? | '**' NAME
LParams = LPos (',' LTail)? ','? | LTail ','?
ParamN = NAME (':' Test)?
ParamD = NAME (':' Test)? '=' Test
ParamA = '*' NAME (':' '*'? Test)?
ParamK = '**' NAME (':' Test)?
ArgS = '*' Test
ArgK = '**' Test
ArgD = NAME '=' Test
ArgG = Named Comp
Comp = ('async'? 'for' Targets 'in' Or ('if' OrLambda)*)+
OrLambda = Or | NAME ':=' Test | 'lambda' LParams? ':' Or
Gen = Named Comp
DictOne = Test ':' Test | '**' Or
DictComp = Test ':' Test Comp
Slice = Named | '*' Or | Test? ':' Test? (':' Test?)?
TypeParam = ('*' | '**')? NAME (':' Test)? ('=' '*'? Test)?
IfH = 'if' Named ':'
ElifH = 'elif' Named ':'
ElseH = 'else' ':'
ForH = 'async'? 'for' Targets 'in' Stars ':'
WhileH = 'while' Named ':'
TryH = 'try' ':'
ExceptH = 'except' ('*'? Test ('as' NAME)?)? ':'
FinallyH = 'finally' ':'
WithH = 'async'? 'with' (WithOne (',' WithOne)* | <Withs>) ':'
WithOne = Test ('as' Target)?
DefH = 'async'? 'def' NAME <TypeParams>? <Params> ('->' Test)? ':'
ClassH = 'class' NAME <TypeParams>? <Args>? ':'
MatchH = 'match' StarNamed (',' StarNamed)* ','? ':'
CaseH = 'case' Pattern (',' Pattern)* ','? ('if' Named)? ':'
Pattern = '*' NAME | PatOr ('as' NAME)?
PatOr = PatOne ('|' PatOne)*
PatOne = '-'? NUM (('+' | '-') NUM)? | Text Text* | BYTES BYTES* | 'None' | 'True' | 'False' | NAME ('.' NAME)* <PatArgs>? | <PatParen> | <PatList> | <PatMap>
PatNamed = NAME '=' PatOr ('as' NAME)?
PatItem = ('-'? NUM (('+' | '-') NUM)? | Text Text* | BYTES BYTES* | 'None' | 'True' | 'False' | NAME '.' NAME ('.' NAME)*) ':' PatOr ('as' NAME)?
PatRest = '**' NAME
Decorator = '@' Named
"""
_PY_SUITE = """
Suite = Stmt*
Stmt = 's' | 'i' 'e'* 'l'? | 'f' 'l'? | 'w' 'l'? | 't' ('x' 'x'* 'l'? 'y'? | 'y') | 'h' | '@' '@'* ('d' | 'c') | 'd' | 'c' | 'm'
Cases = 'k' 'k'*
"""
_PY_NAMES = "match case type"
_INDENT = 0x100000
_LINES = re.compile(f"([{chr(_INDENT)}-{chr(_INDENT + 0xFFFD)}])")
# The rule of each first word of a compound statement, and its character in a suite.
_PY_HEADS = {
    "if": ("IfH", "i"), "elif": ("ElifH", "e"), "else": ("ElseH", "l"), "for": ("ForH", "f"), "while": ("WhileH", "w"), "try": ("TryH", "t"), "except": ("ExceptH", "x"), "finally": ("FinallyH", "y"),
    "with": ("WithH", "h"), "def": ("DefH", "d"), "class": ("ClassH", "c"), "match": ("MatchH", "m"), "case": ("CaseH", "k"),
}


class _TooManyIndents(Exception):
    pass


#: The order of arguments, and of parameters with the slash left out, by their letters.
_ARGS = re.compile("g|[ps]*[ds]*[dk]*")
_PARAMS = re.compile("n*d*(?:a[nd]*|\\*[nd]+)?k?")
#: Escapes that stand for a character, and those that don't, in texts and in bytes.
_ESCAPES = re.compile(r"(?:[^\\]|\\(?:[^xuUN]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U(?:000[\da-fA-F]|0010)[\da-fA-F]{4}|N\{[^{}]+\}))*+")
_BYTE_ESCAPES = re.compile(r"(?:[^\\]|\\(?:[^x]|x[\da-fA-F]{2}))*+")


class Python(Language):
    def __init__(self) -> None:
        g = self.g = _grammar(_PY, {"NAME": "n", "NUM": "1", "STR": "s", "BYTES": "b", "FORMATTED": "f"}, _PY_NAMES)
        self.suites = Grammar(_PY_SUITE, {}, {c: c for c in "sielfwtxyh@dcmk"})
        self.cut = re.compile(r"(?<=.)(?=[sifwth@dcm])(?<!@)")
        self.heads = {g.chars[w]: v for w, v in _PY_HEADS.items()}
        self.asynchronous, self.lambda_, self.for_, self.in_ = (g.chars[w] for w in ("async", "lambda", "for", "in"))
        self.indents: dict[tuple[int, int], str] = {}
        self.columns: dict[str, tuple[int, int]] = {}
        base = _other("n", "1", "s")

        def kind(t: str) -> str:
            c = t[0]
            if c == "#" or (c == "\\" and len(t) > 1):
                return ""
            if c in "\r\n":
                return self._indent(t.lstrip("\r\n"))
            if t[-1] in "\"'":
                if len(t) < 2:
                    return ERROR
                prefix = t[: min(k for k in (t.find("'"), t.find('"')) if k >= 0)].lower()
                if "b" in prefix:
                    return "b" if t.isascii() and ("r" in prefix or "\\" not in t or _BYTE_ESCAPES.fullmatch(t)) else ERROR
                return "s" if "r" in prefix or "\\" not in t or _ESCAPES.fullmatch(t) else ERROR
            return ERROR if c in "$?!`/\0" else base(t)

        self.kinds = Kinds(_fixed(g) | {FORMATTED: "f"}, kind)
        accepts, comma = g.accepts, self._comma

        def every(rule: str, blank: bool = True) -> tuple[Callable[[Dialect, str], bool]]:
            return (lambda d, s: (blank and s == "") or all(accepts(rule, p) for p in comma(s)),)

        def paren(d: Dialect, s: str) -> bool:
            parts = comma(s)
            if s and len(parts) == 1 and s[-1] != ",":
                return accepts("Named", s) or accepts("Gen", s) or accepts("Yield", s)
            return s == "" or all(accepts("StarNamed", p) for p in parts)

        def either(one: str, many: str, extra: str = "") -> Callable[[Dialect, str], bool]:
            """A comprehension, which stands alone, or elements."""
            return lambda d, s: s == "" or all(accepts(many, p) for p in comma(s)) or accepts(one, s)

        def args(d: Dialect, s: str) -> bool:
            parts = comma(s) if s else []
            letters = "".join("p" if accepts("Named", p) else "s" if accepts("ArgS", p) else "d" if accepts("ArgD", p) else "k" if accepts("ArgK", p) else "g" if accepts("ArgG", p) else "!" for p in parts)
            return _ARGS.fullmatch(letters) is not None

        def params(d: Dialect, s: str) -> bool:
            parts = comma(s) if s else []
            letters = "".join("/" if p == "/" else "*" if p == "*" else "n" if accepts("ParamN", p) else "d" if accepts("ParamD", p) else "a" if accepts("ParamA", p) else "k" if accepts("ParamK", p) else "!" for p in parts)
            head, slash, tail = letters.partition("/")
            return _PARAMS.fullmatch(head + tail) is not None and not (slash and re.fullmatch("[nd]+", head) is None)

        def targets(rule: str, one: str) -> Callable[[Dialect, str], bool]:
            """In round brackets one target without a comma stands for itself."""
            return lambda d, s: s == "" or (accepts(one, s) if len(comma(s)) == 1 and s[-1:] != "," else all(accepts(rule, p) for p in comma(s)))

        def pattern(d: Dialect, s: str) -> bool:
            return s == "" or (len(comma(s)) == 1 and s[-1] != "," and s[0] != "*" and accepts("Pattern", s)) or ((s[-1] == "," or len(comma(s)) > 1) and all(accepts("Pattern", p) for p in comma(s)))

        def arguments(d: Dialect, s: str) -> bool:
            letters = "".join("p" if p[:1] != "*" and accepts("Pattern", p) else "k" if accepts("PatNamed", p) else "!" for p in comma(s)) if s else ""
            return re.fullmatch("p*k*", letters) is not None

        def mapping(d: Dialect, s: str) -> bool:
            parts = comma(s) if s else []
            return all(accepts("PatItem", p) for p in parts[:-1]) and (not parts or accepts("PatItem", parts[-1]) or accepts("PatRest", parts[-1]))

        roles = {
            "(": {
                "Paren": (paren,), "Args": (args,), "Params": (params,), "TargetP": (targets("StarTarget", "Target"),), "TargetOne": (lambda d, s: accepts("Single", s),), "DelP": (lambda d, s: s == "" or accepts("DelTargets", s),),
                "Froms": every("FromOne", False), "Withs": every("WithOne", False), "PatArgs": (arguments,), "PatParen": (pattern,),
            },
            "[": {
                "List": (either("Gen", "StarNamed"),), "Index": (lambda d, s: s != "" and all(accepts("Slice", p) for p in comma(s)),), "TargetL": every("StarTarget"), "DelL": (lambda d, s: s == "" or accepts("DelTargets", s),),
                "TypeParams": every("TypeParam", False), "PatList": every("Pattern"),
            },
            "{": {"Dict": (lambda d, s: s == "" or all(accepts("DictOne", p) for p in comma(s)) or accepts("DictComp", s) or all(accepts("StarNamed", p) for p in comma(s)) or accepts("Gen", s),), "PatMap": (mapping,)},
            SUB: {"Field": ("FieldOne",)},
        }
        self.dialect = Dialect("python", g, roles, lambda s: _LINES.sub("", s))

    def _comma(self, text: str) -> list[str]:
        """The parts between commas, without those of a lambda's parameters and of the targets of a comprehension."""
        parts = text.removesuffix(",").split(",")
        if self.lambda_ not in text and self.for_ not in text:
            return parts
        out, start, lambdas, targets = [], 0, 0, False
        end = len(text) - text.endswith(",")
        for i in range(end):
            c = text[i]
            if c == self.lambda_:
                lambdas += 1
            elif c == ":" and lambdas:
                lambdas -= 1
            elif c == self.for_:
                targets = True
            elif c == self.in_:
                targets = False
            elif c == "," and not lambdas and not targets:
                out.append(text[start:i])
                start = i + 1
        return [*out, text[start:end]]

    def _indent(self, blanks: str) -> str:
        """The character of a line's indent, by its columns with tabs of eight and of one; of very many in a worker the first are forgotten between files."""
        wide = narrow = 0
        for c in blanks:
            if c == "\t":
                wide, narrow = wide // 8 * 8 + 8, narrow + 1
            elif c == "\f":
                wide = narrow = 0
            else:
                wide, narrow = wide + 1, narrow + 1
        char = self.indents.get((wide, narrow))
        if char is None:
            if len(self.indents) > 0xFFFC:
                raise _TooManyIndents
            char = self.indents[wide, narrow] = chr(_INDENT + len(self.indents))
            self.columns[char] = (wide, narrow)
        return char

    def _head(self, line: str) -> tuple[str, str, str] | None:
        """Rule and character of a compound statement's first line, and the simple statements behind its colon."""
        found = self.heads.get(line[0]) or (self.heads.get(line[1]) if line[0] == self.asynchronous and len(line) > 1 else None)
        if found is None:
            return None
        at = -1
        while (at := line.find(":", at + 1)) >= 0:  # lambdas have colons too
            if self.g.accepts(found[0], line[: at + 1]):
                return found[0], found[1], line[at + 1 :]
        return None

    def accepts(self, content: str, deepest: int | None = DEEPEST) -> bool:
        if "\0" in content:
            return False
        tokens = lexing.python_tokens("\n" + content.removeprefix("\ufeff"))
        try:
            shape = "".join(map(self.kinds.__getitem__, tokens))
        except _TooManyIndents:  # the characters of indents begin anew
            self.__init__()  # type: ignore[misc]
            shape = "".join(map(self.kinds.__getitem__, tokens))
        if ERROR in shape:
            return False
        reduced = self.dialect.reduce(shape, deepest)
        if reduced is None:
            return False
        g, suites = self.g, self.suites
        parts = _LINES.split(reduced)[1:]
        stack: list[tuple[int, int]] = [(0, 0)]
        levels: list[list[str]] = [[]]  # the characters of each open suite
        kinds = [""]
        waiting = ""
        for indent, line in zip(parts[::2], parts[1::2], strict=True):
            if not line:
                continue
            column = self.columns[indent]
            if waiting:
                if column[0] <= stack[-1][0] or column[1] <= stack[-1][1]:
                    return False
                stack.append(column)
                levels.append([])
                kinds.append(waiting)
            else:
                while column[0] < stack[-1][0]:
                    stack.pop()
                    if not self._suite(kinds.pop(), levels.pop()):
                        return False
                if column != stack[-1]:
                    return False
            waiting = ""
            head = self._head(line)
            if head is None or (head[1] == "m" and head[2]):
                if line[0] == "@" and g.accepts("Decorator", line):
                    levels[-1].append("@")
                elif g.accepts("Simple", line):
                    levels[-1].append("s")
                else:
                    return False
                continue
            levels[-1].append(head[1])
            if head[2]:
                if not g.accepts("Simple", head[2]):
                    return False
            else:
                waiting = head[1]
        if waiting:
            return False
        while levels:
            if not self._suite(kinds.pop(), levels.pop()):
                return False
        return True

    def _suite(self, of: str, parts: list[str]) -> bool:
        if of == "m":
            return self.suites.accepts("Cases", "".join(parts))
        return all(p == "" or self.suites.accepts("Suite", p) for p in self.cut.split("".join(parts)))
