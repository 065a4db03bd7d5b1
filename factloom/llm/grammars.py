"""Grammars of the four languages for :mod:`derivatives`.

They describe the syntax that decides whether a file is valid, wide where only later phases of
a compiler would object. Tokens are those of :mod:`lexers`; a greater-than sign is always a
token of its own, so that nested type arguments need no special care.
"""

from __future__ import annotations

from functools import lru_cache

from .derivatives import Grammar
from ..functions.lexers import CSHARP_KEYWORDS, CSHARP_NAMES, ECMA_KEYWORDS, ECMA_NAMES

_RESERVED_TYPES = "void null true false this typeof"


def _either(words: object) -> str:
    return " | ".join(f"'{w}'" for w in sorted(words))


def _ecma(types: bool) -> str:
    """Rules of TypeScript (types) or JavaScript."""

    def ts(text: str) -> str:
        return text if types else ""

    names = sorted(ECMA_NAMES)
    # What an arrow's or a statement's expression may not begin with needs rules of its own.
    levels = []
    for p, barred in (("", ()), ("b", ("{",)), ("s", ("{", "function", "class"))):
        first = ["ident", "num", "str", "regex", "template", "'(' expr ')'", "array", "'this'", "'super'", "'null'", "'true'", "'false'", "priv", "'import' ( '(' assign [ ',' assign ] [ ',' ] ')' | '.' 'meta' | '.' id )", "'new' ( '.' name | postfix )"]
        if "{" not in barred:
            first.append("object")
        if "function" not in barred:
            first += ["['async'] function", "class"]
        levels.append(f"""
{p}expr = {p}assign {{ ',' assign }}
{p}assign = arrow | 'yield' [ ['*'] assign ] | {p}chain {ts("| typeparams arrow_rest | 'async' typeparams arrow_rest")}
{p}chain = {p}unary {{ binop unary {ts("| 'as' ( type | 'const' ) | 'satisfies' type")} }} [ assignop assign | '?' assign ':' assign ]
{p}unary = prefix unary | {p}postfix {ts("| '<' ( type | 'const' ) '>' unary")}
{p}postfix = {p}primary {{ suffix }} [ '++' | '--' ]
{p}primary = {' | '.join(first)}
""")
    return (
        f"""
program = {{ item }}
item = import | export | stmt
ident = id | {_either(names)}
name = ident | {_either(ECMA_KEYWORDS)}
import = 'import' ( str | {ts("['type']")} importclause 'from' str ) [ ('with' | 'assert') object ] ';' {ts("| 'import' ident '=' ( 'require' '(' str ')' | ident { '.' name } ) ';'")}
importclause = ident [ ',' ( named | '*' 'as' ident ) ] | named | '*' 'as' ident
named = '{{' [ nameditem {{ ',' nameditem }} [','] ] '}}'
nameditem = {ts("['type']")} (name | str) [ 'as' (name | str) ]
export = {{ decorator }} 'export' ( declaration | 'default' ( ['async'] function | class | sassign ';' {ts("| interface | 'abstract' class")} ) | {ts("['type']")} ( named [ 'from' str [ 'with' object ] ] | '*' [ 'as' (name | str) ] 'from' str [ 'with' object ] ) ';' {ts("| '=' expr ';' | 'as' 'namespace' ident ';'")} )
declaration = ['async'] function | {ts("['abstract']")} class | vars ';' {ts("| tsdecl")}
stmt = block | declaration | ';' | sexpr ';' | ident ':' stmt
 | 'if' '(' expr ')' stmt [ 'else' stmt ]
 | 'for' ['await'] '(' ( [ forinit ] ';' [ expr ] ';' [ expr ] | ( vardecl | postfix ) ( 'of' assign | 'in' expr ) ) ')' stmt
 | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' [ ';' ]
 | ('continue' | 'break') [ ident ] ';' | 'return' [ expr ] ';' | 'throw' expr ';' | 'debugger' ';'
 | 'try' block ( 'catch' [ '(' target {ts("[ ':' type ]")} ')' ] block [ 'finally' block ] | 'finally' block )
 | 'switch' '(' expr ')' '{{' {{ 'case' expr ':' {{ stmt }} | 'default' ':' {{ stmt }} }} '}}' {ts("| 'with' '(' expr ')' stmt")}
block = '{{' {{ stmt }} '}}'
forinit = vars | expr
varword = 'var' | 'let' | 'const' | ['await'] 'using'
vardecl = varword target {ts("[ ':' type ]")}
vars = {"varword vardef { ',' vardef }" if types else "( 'var' | 'let' ) vardef { ',' vardef } | ( 'const' | ['await'] 'using' ) target '=' assign { ',' target '=' assign }"}
vardef = target {ts("['!'] [ ':' type ]")} [ '=' assign ]
target = ident | '[' [ elem ] {{ ',' [ elem ] }} ']' | '{{' [ field {{ ',' field }} [','] ] '}}'
elem = ['...'] target [ '=' assign ]
field = '...' ident | ident [ '=' assign ] | propname ':' target [ '=' assign ]
function = 'function' ['*'] [ ident ] {ts("[ typeparams ]")} params {ts("[ ':' rettype ]")} ( block {ts("| ';'")} )
params = '(' [ param {{ ',' param }} [','] ] ')'
param = {{ decorator }} {ts("{ 'public' | 'private' | 'protected' | 'readonly' | 'override' }")} ['...'] ( target {ts("| 'this'")} ) {ts("['?'] [ ':' type ]")} [ '=' assign ]
class = {{ decorator }} 'class' [ ident ] {ts("[ typeparams ]")} [ 'extends' postfix {ts("[ typeargs ]")} ] {ts("[ 'implements' type { ',' type } ]")} '{{' {{ member }} '}}'
decorator = '@' ( ident {{ '.' name }} [ {ts("[ typeargs ]")} args ] | '(' expr ')' )
member = ';' | 'static' block | {{ decorator }} {{ modifier }} ( method | propname {ts("[ '?' | '!' ] [ ':' type ]")} [ '=' assign ] ';' {ts("| '[' ident ':' type ']' ':' type ';'")} )
modifier = 'static' | 'accessor' {ts("| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'")}
method = ['async'] ['*'] propname {ts("['?'] [ typeparams ]")} params {ts("[ ':' rettype ]")} ( block {ts("| ';'")} ) | ('get' | 'set') propname params {ts("[ ':' type ]")} ( block {ts("| ';'")} )
propname = name | str | num | priv | '[' assign ']'
arrow = ['async'] ( ident '=>' body | arrow_rest )
arrow_rest = params {ts("[ ':' rettype ]")} '=>' body
body = block | bassign
prefix = '!' | '~' | '+' | '-' | '++' | '--' | 'line++' | 'line--' | 'typeof' | 'void' | 'delete' | 'await'
suffix = '.' (name | priv) | '?.' ( name | priv | '[' expr ']' | args ) | '[' expr ']' | args | template {ts("| '!' | typeargs ( args | template )")}
args = '(' [ arg {{ ',' arg }} [','] ] ')'
arg = ['...'] assign
array = '[' [ arg ] {{ ',' [ arg ] }} ']'
object = '{{' [ prop {{ ',' prop }} [','] ] '}}'
prop = '...' assign | ident [ '=' assign ] | propname ':' assign | ['async'] ['*'] propname {ts("[ typeparams ]")} params {ts("[ ':' rettype ]")} block | ('get' | 'set') propname params {ts("[ ':' type ]")} block
template = tpl | tplhead expr {{ tplmid expr }} tplend
binop = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '<=' | '>' [ '>' [ '>' ] ] | '>' '=' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | 'in' | 'instanceof'
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>' [ '>' ] '=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
"""
        + "".join(levels)
        + ts(f"""
tsdecl = interface | 'type' ident [ typeparams ] '=' type ';' | ['const'] 'enum' ident '{{' [ enumitem {{ ',' enumitem }} [','] ] '}}'
 | ('namespace' | 'module') ( ident {{ '.' name }} | str ) '{{' {{ item }} '}}' | 'declare' ( declaration | 'module' str ( '{{' {{ item }} '}}' | ';' ) | 'global' '{{' {{ item }} '}}' )
enumitem = (name | str) [ '=' assign ]
interface = 'interface' ident [ typeparams ] [ 'extends' type {{ ',' type }} ] typebody
typebody = '{{' [ typemember {{ (';' | ',') typemember }} [ ';' | ',' ] ] '}}'
typemember = {{ 'readonly' | '+' | '-' }} ( propname ['?'] [ ':' type ] | [ 'get' | 'set' ] propname ['?'] [ typeparams ] params [ ':' rettype ] | ['new'] [ typeparams ] params [ ':' rettype ] | '[' ident ':' type ']' ':' type | '[' ident 'in' type [ 'as' type ] ']' [ [ '+' | '-' ] '?' ] [ ':' type ] )
rettype = type | ['asserts'] (ident | 'this') 'is' type | 'asserts' (ident | 'this')
type = union [ 'extends' union '?' type ':' type ] | ['abstract'] ['new'] [ typeparams ] params '=>' rettype
union = [ '|' ] inter {{ '|' inter }}
inter = [ '&' ] typeop {{ '&' typeop }}
typeop = {{ 'keyof' | 'unique' | 'readonly' | 'infer' }} typeprimary {{ '[' [ type ] ']' }}
typeprimary = ident {{ '.' name }} [ typeargs ] | {' | '.join(f"'{w}'" for w in _RESERVED_TYPES.split() if w != "typeof")} | str | ['-'] num | 'typeof' ( ident | 'this' | 'import' '(' str ')' ) {{ '.' name }} [ typeargs ] | '(' type ')' | typebody | '[' [ tupleitem {{ ',' tupleitem }} [','] ] ']' | tpl | tplhead type {{ tplmid type }} tplend | 'import' '(' str ')' {{ '.' name }} [ typeargs ]
tupleitem = ['...'] [ ident ['?'] ':' ] type ['?']
typeargs = '<' type {{ ',' type }} '>'
typeparams = '<' typeparam {{ ',' typeparam }} [','] '>'
typeparam = {{ 'const' | 'in' | 'out' }} ident [ 'extends' type ] [ '=' type ]
""")
    )


_PREDEFINED = "bool byte char decimal double float int long object sbyte short string uint ulong ushort void"
_MODIFIERS = "abstract async const extern file internal new override partial private protected public readonly ref required sealed static unsafe virtual volatile"
_CSHARP = f"""
unit = {{ 'extern' 'alias' ident ';' }} {{ using }} {{ attributes }} {{ nsitem }}
ident = id | {_either(CSHARP_NAMES)}
using = ['global'] 'using' [ 'static' | 'unsafe' ] [ ident '=' ] type ';'
qname = ident {{ ('.' | '::') ident }}
nsitem = namespace | typedecl | stmt
namespace = 'namespace' qname ( '{{' {{ using }} {{ nsblockitem }} '}}' [';'] | ';' {{ using }} )
nsblockitem = namespace | typedecl
attributes = '[' [ (ident | 'return' | 'event') ':' ] attribute {{ ',' attribute }} [','] ']'
attribute = qname [ typeargs ] [ '(' [ attrarg {{ ',' attrarg }} ] ')' ]
attrarg = [ ident ('=' | ':') ] expr
modifier = {_either(_MODIFIERS.split())}
typedecl = {{ attributes }} {{ modifier }} ( ( 'class' | 'struct' | 'interface' | 'record' [ 'class' | 'struct' ] ) ident [ typeparams ] [ params ] [ ':' base {{ ',' base }} ] {{ where }} ( '{{' {{ member }} '}}' [';'] | ';' ) | enum | 'delegate' type ident [ typeparams ] params {{ where }} ';' )
base = type [ args ]
enum = 'enum' ident [ ':' type ] '{{' [ enumitem {{ ',' enumitem }} [','] ] '}}' [';']
enumitem = {{ attributes }} ident [ '=' expr ]
where = 'where' ident ':' constraint {{ ',' constraint }}
constraint = 'class' ['?'] | 'struct' | 'new' '(' ')' | 'notnull' | 'default' | type
typeparams = '<' {{ attributes }} [ 'in' | 'out' ] ident {{ ',' {{ attributes }} [ 'in' | 'out' ] ident }} '>'
params = '(' [ param {{ ',' param }} ] ')'
param = {{ attributes }} {{ 'ref' | 'out' | 'in' | 'params' | 'this' | 'readonly' | 'scoped' }} type ident [ '=' expr ]
member = typedecl | {{ attributes }} {{ modifier }} ( ident params [ ':' ('base' | 'this') args ] methodbody | '~' ident '(' ')' methodbody | type memberrest | ('implicit' | 'explicit') 'operator' ['checked'] type params methodbody | 'event' type ( ident [ '=' expr ] {{ ',' ident [ '=' expr ] }} ';' | qname accessors ) )
memberrest = ident [ '=' init ] {{ ',' ident [ '=' init ] }} ';' | membername ( [ typeparams ] params {{ where }} methodbody | accessors [ '=' expr ';' ] | '=>' expr ';' ) | [ qname '.' ] 'this' '[' param {{ ',' param }} ']' ( accessors | '=>' expr ';' ) | 'operator' ['checked'] overload params methodbody | ident '[' expr ']' ';'
membername = {{ ident [ typeargs ] '.' }} ident
overload = '+' | '-' | '!' | '~' | '++' | '--' | 'true' | 'false' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' [ '>' [ '>' ] ] | '==' | '!=' | '<' | '<=' | '>' '='
methodbody = block | '=>' expr ';' | ';'
accessors = '{{' {{ accessor }} '}}'
accessor = {{ attributes }} {{ modifier }} ( 'get' | 'set' | 'init' | 'add' | 'remove' ) ( ';' | block | '=>' expr ';' )
type = typebase {{ '?' | '*' | '[' {{ ',' }} ']' }}
typebase = {_either(_PREDEFINED.split())} | typename | '(' type [ ident ] ',' type [ ident ] {{ ',' type [ ident ] }} ')' | 'ref' ['readonly'] type | 'delegate' '*' [ ident ] [ '[' ident {{ ',' ident }} ']' ] '<' type {{ ',' type }} '>'
typename = ident [ typeargs ] {{ ('.' | '::') ident [ typeargs ] }}
typeargs = '<' ( type {{ ',' type }} | {{ ',' }} ) '>'
block = '{{' {{ stmt }} '}}'
stmt = block | ';' | local ';' | expr ';' | ident ':' stmt | localfunction
 | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
 | 'for' '(' [ local | expr {{ ',' expr }} ] ';' [ expr ] ';' [ expr {{ ',' expr }} ] ')' stmt
 | ['await'] 'foreach' '(' ( type ident | 'var' designation | expr ) 'in' expr ')' stmt
 | 'switch' ( '(' expr ')' ) '{{' {{ label {{ label }} {{ stmt }} }} '}}'
 | 'return' [ expr ] ';' | 'break' ';' | 'continue' ';' | 'goto' ( ident | 'case' expr | 'default' ) ';' | 'throw' [ expr ] ';'
 | 'yield' ( 'return' expr | 'break' ) ';'
 | 'try' block ( catch {{ catch }} [ 'finally' block ] | 'finally' block )
 | ['await'] 'using' ( '(' ( local | expr ) ')' stmt | local ';' )
 | 'lock' '(' expr ')' stmt | 'fixed' '(' local ')' stmt | ('checked' | 'unchecked' | 'unsafe') block
label = 'case' pattern [ 'when' expr ] ':' | 'default' ':'
catch = 'catch' [ '(' type [ ident ] ')' ] [ 'when' '(' expr ')' ] block
local = ['const'] ['scoped'] type ident [ '=' init ] {{ ',' ident [ '=' init ] }} | 'var' designation '=' expr
init = expr | '{{' [ init {{ ',' init }} [','] ] '}}' | 'ref' expr
designation = '(' designated {{ ',' designated }} ')'
designated = ident | designation
localfunction = {{ attributes }} {{ 'static' | 'async' | 'unsafe' | 'extern' }} type ident [ typeparams ] params {{ where }} ( block | '=>' expr ';' )
expr = lambda | query | 'throw' expr | 'ref' expr | chain [ assignop ( expr | '{{' [ init {{ ',' init }} [','] ] '}}' ) | '?' expr ':' expr ]
lambda = {{ attributes }} {{ 'static' | 'async' }} ( ident '=>' lambdabody | [ type ] '(' [ lambdaparam {{ ',' lambdaparam }} ] ')' '=>' lambdabody ) | {{ 'static' | 'async' }} 'delegate' [ params ] block
lambdaparam = {{ attributes }} {{ 'ref' | 'out' | 'in' | 'params' | 'scoped' }} [ type ] ident [ '=' expr ]
lambdabody = block | expr
chain = unary {{ binop ( unary | lambda | 'throw' expr ) | '..' | 'is' pattern | 'as' type | 'switch' '{{' [ arm {{ ',' arm }} [','] ] '}}' | 'with' '{{' [ meminit {{ ',' meminit }} [','] ] '}}' }}
arm = pattern [ 'when' expr ] '=>' expr
unary = prefix unary | '(' type ')' unary | postfix | '..' [ unary ]
prefix = '+' | '-' | '!' | '~' | '++' | '--' | 'await' | '^' | '&' | '*'
postfix = primary {{ suffix }}
suffix = '.' ident [ typeargs ] | '?.' ident [ typeargs ] | '?' '[' arg {{ ',' arg }} ']' | '->' ident | '[' arg {{ ',' arg }} ']' | args | '++' | '--' | '!' | '::' ident [ typeargs ]
primary = ident [ typeargs ] | num | str | chr | 'this' | 'base' | 'true' | 'false' | 'null' | '(' expr ')' | '(' tupleitem ',' tupleitem {{ ',' tupleitem }} ')' | 'default' [ '(' type ')' ] | ('typeof' | 'sizeof') '(' ( type | 'void' | typename ) ')' | ('checked' | 'unchecked') '(' expr ')' | new | '[' [ ( expr | '..' expr ) {{ ',' ( expr | '..' expr ) }} [','] ] ']' | {_either(w for w in _PREDEFINED.split() if w != "void")} | 'stackalloc' [ type ] [ '[' [ expr ] ']' ] [ arrayinit ]
tupleitem = [ ident ':' ] ( expr | type ident )
args = '(' [ arg {{ ',' arg }} ] ')'
arg = [ ident ':' ] ( expr | ('ref' | 'in') expr | 'out' ( expr | type ident | 'var' ident ) | '..' [ expr ] )
new = 'new' ( args [ objinit ] | '{{' [ anon {{ ',' anon }} [','] ] '}}' | '[' {{ ',' }} ']' arrayinit | newtype ( args [ objinit ] | objinit | '[' expr {{ ',' expr }} ']' {{ '[' {{ ',' }} ']' }} [ arrayinit ] | '[' {{ ',' }} ']' {{ '[' {{ ',' }} ']' }} arrayinit ) )
newtype = typebase ['?']
anon = [ ident '=' ] expr
objinit = '{{' [ elem {{ ',' elem }} [','] ] '}}'
elem = meminit | expr | '{{' expr {{ ',' expr }} '}}'
meminit = ( ident | '[' arg {{ ',' arg }} ']' ) '=' ( expr | objinit )
arrayinit = '{{' [ init {{ ',' init }} [','] ] '}}'
pattern = patternor
patternor = patternand {{ 'or' patternand }}
patternand = patternnot {{ 'and' patternnot }}
patternnot = {{ 'not' }} patternbase
patternbase = chain2 | type [ ident ] | 'var' ( ident | designation ) | [ type ] '(' [ subpattern {{ ',' subpattern }} ] ')' [ propertypattern ] [ ident ] | [ type ] propertypattern [ ident ] | ( '<' | '<=' | '>' [ '=' ] ) chain2 | '[' [ pattern {{ ',' pattern }} ] ']' [ ident ] | '..' [ pattern ]
chain2 = unary {{ binop2 unary }}
binop2 = '+' | '-' | '*' | '/' | '%' | '|' | '&' | '<<'
subpattern = [ ident {{ '.' ident }} ':' ] pattern
propertypattern = '{{' [ subpattern {{ ',' subpattern }} [','] ] '}}'
binop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '<=' | '>' [ '>' [ '>' ] ] | '>' '=' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '..'
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '<<=' | '>' '>' [ '>' ] '=' | '&=' | '|=' | '^=' | '??='
query = 'from' [ type ] ident 'in' expr {{ clause }} ( 'select' expr | 'group' expr 'by' expr ) [ 'into' ident {{ clause }} ( 'select' expr | 'group' expr 'by' expr ) ]
clause = 'from' [ type ] ident 'in' expr | 'let' ident '=' expr | 'where' expr | 'join' [ type ] ident 'in' expr 'on' expr 'equals' expr [ 'into' ident ] | 'orderby' expr [ 'ascending' | 'descending' ] {{ ',' expr [ 'ascending' | 'descending' ] }}
"""

_ELIXIR = """
program = [ sep ] [ expr { sep expr } [ sep ] ]
sep = ( nl | ';' ) { nl | ';' }
block = [ sep ] [ stabs | expr { sep expr } [ sep ] ]
stabs = stab { sep stab } [ sep ]
stab = [ stabargs ] '->' [ nl ] [ expr { sep expr } ]
stabargs = arg { ',' [ nl ] arg } [ 'when' expr ]
doblock = 'do' block { ( 'else' | 'rescue' | 'catch' | 'after' ) block } 'end'
expr = unary { binop [ nl ] unary }
unary = prefix [ nl ] unary | postfix [ doblock ]
prefix = 'not' | '!' | '-' | '+' | '&' | '^' | '@' | '~~~' | '..' | '...'
postfix = primary { suffix } [ '.' ( id | str ) bare ] | id bare
suffix = '.' ( id | alias | str | '{' [ nl ] list '}' ) | '.' callargs | callargs | 'at[' [ nl ] expr [ nl ] ']'
callargs = 'call(' [ nl ] [ args ] ')'
bare = arg { ',' [ nl ] arg }
args = ( kws | expr { ',' [ nl ] expr } [ ',' [ nl ] kws ] ) [ ',' ] [ nl ]
arg = expr | kw [ nl ] expr
kws = kw [ nl ] expr { [ nl ] ',' [ nl ] kw [ nl ] expr }
list = [ ( kws | expr { [ nl ] ',' [ nl ] expr } [ [ nl ] ',' [ nl ] kws ] ) [ ',' ] [ nl ] ]
primary = id | alias | num | str | chr | atom | 'nil' | 'true' | 'false' | '...'
 | ( '(' | 'call(' ) block ')' | ( '[' | 'at[' ) [ nl ] list ']' | '{' [ nl ] list '}' | '<<' [ nl ] list '>>'
 | '%' ( '{' [ nl ] maplist '}' | ( alias { '.' alias } | id | '^' id | '@' id ) '{' [ nl ] maplist '}' )
 | 'fn' [ nl ] stabs 'end' | '&' num
maplist = [ expr [ nl ] '|' [ nl ] ] list
binop = '.' | '**' | '*' | '/' | '+' | '-' | '++' | '--' | '+++' | '---' | '..' | '<>' | '|>' | '<<<' | '>>>' | '<<~' | '~>>' | '<~' | '~>' | '<~>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '=~' | '===' | '!==' | '&&' | '&&&' | 'and' | '||' | '|||' | 'or' | '=' | '|' | '::' | 'when' | '<-' | '\\\\' | 'in' | 'not' 'in' | '=>' | '//' | '^^^'
"""


@lru_cache(maxsize=8)
def grammar(language: str) -> Grammar:
    """The grammar of a language."""
    if language == "csharp":
        return Grammar(_CSHARP, "unit")
    if language == "elixir":
        return Grammar(_ELIXIR, "program")
    return Grammar(_ecma(language == "typescript"), "program")
