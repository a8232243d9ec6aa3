"""Grammars and token patterns of the supported languages.

Expressions are flat (operands and operators in turn): precedence does not matter for acceptance.
Words in quotes that are not punctuation are reserved in that language.
"""

JAVA = r"""
unit : {item}
compact : {item | member}
modular : {imp} {ann} ['open'] 'module' qname '{' {directive} '}'
directive : ID {ID | '.' | ',' | 'static'} ';'
item : {ann} 'package' qname ';' | imp | {mod} typedecl | ';'
imp : 'import' ['static'] qname ['.' '*'] ';'
qname : ID {'.' ID}
mod : 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' | ann
annargs : annarg {',' annarg}
annarg : ID '=' annval | annval
annval : expr | '{' [annval {',' annval} [',']] '}' | ann
typedecl : 'class' ID [tparams] ['extends' type] ['implements' types] [permits] classbody
 | 'interface' ID [tparams] ['extends' types] [permits] classbody
 | '@' 'interface' ID classbody
 | 'enum' ID ['implements' types] enumbody
 | 'record' ID [tparams] '(' [params] ')' ['implements' types] recordbody
permits : 'permits' types
types : type {',' type}
tparams : '<' tparam {',' tparam} '>'
tparam : {ann} ID ['extends' type {'&' type}]
type : {ann} (prim | ID [targs] {'.' ID [targs]}) {'[' ']'}
ann : '@' qname ['(' [annargs] ')']
prim : 'int' | 'long' | 'double' | 'float' | 'boolean' | 'char' | 'byte' | 'short' | 'void'
targs : '<' [targ {',' targ}] '>'
targ : type | {ann} '?' [('extends' | 'super') type]
classbody : '{' {member} '}'
recordbody : '{' {member | {mod} ID block} '}'
enumbody : '{' [econst {',' econst}] [','] [';' {member}] '}'
econst : {ann} ID ['(' [args] ')'] [classbody]
member : ';' | ['static'] block | {mod} typedecl | {mod} [tparams] type ID '(' [params] ')' {'[' ']'} ['throws' types] (block | ['default' annval] ';')
 | {mod} [tparams] ID '(' [params] ')' ['throws' types] block | {mod} type vars ';'
params : param {',' param}
param : {'final' | ann} type ['...'] (ID | 'this') {'[' ']'}
vars : var {',' var}
var : ID {'[' ']'} ['=' init]
init : expr | '{' [init {',' init} [',']] '}'
block : '{' {stmt} '}'
stmt : block | ';' | simple ';' | {'final' | 'abstract' | 'static' | 'strictfp' | 'sealed' | ann} typedecl | 'yield' expr ';'
 | 'if' '(' expr ')' stmt ['else' stmt] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
 | 'for' '(' [forinit] ';' [expr] ';' [args] ')' stmt | 'for' '(' {'final' | ann} type ID ':' expr ')' stmt
 | ID ':' stmt | 'switch' '(' expr ')' switchbody | 'synchronized' '(' expr ')' block
 | 'try' ['(' res {';' res} [';'] ')'] block {'catch' '(' {'final' | ann} type {'|' type} ID ')' block} ['finally' block]
simple : {'final' | ann} type vars | effect | 'return' [expr] | 'break' [ID] | 'continue' [ID] | 'throw' expr | 'assert' expr [':' expr]
effect : ('++' | '--') operand | primary {trailer} does | new
does : '(' [args] ')' | '++' | '--' | '.' new | assign expr
assign : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
res : {'final' | ann} type ID '=' expr | expr
forinit : {'final' | ann} type vars | args
switchbody : '{' {label} '}'
label : ('case' labels | 'default') (':' {stmt} | '->' (expr ';' | block | 'throw' expr ';'))
labels : labelx {',' labelx}
labelx : expr | (type ID | pattern) ['when' expr] | 'default'
pattern : type '(' [sub {',' sub}] ')' [ID]
sub : {'final' | ann} type ID | pattern | ID
args : expr {',' expr}
expr : operand {binop operand | 'instanceof' {'final' | ann} (type [ID] | pattern)} ['?' expr ':' expr] | lambda
lambda : (ID | '(' [lparams] ')') '->' (expr | block)
lparams : ID {',' ID} | params
binop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<' '<' | '>' '>' | '>' '>' '>' | assign
operand : ('+' | '-' | '++' | '--' | '!' | '~') operand | '(' type {'&' type} ')' operand | primary {trailer} | lambda | 'switch' '(' expr ')' switchbody
primary : ID | NUM | STR | CHAR | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | new | type '::' (ID | 'new') | type '.' 'class'
new : 'new' {ann} ntype ('(' [args] ')' [classbody] | '[' expr ']' {'[' expr ']'} {'[' ']'} | '[' ']' {'[' ']'} '{' [init {',' init} [',']] '}')
ntype : prim | ID [targs] {'.' {ann} ID [targs]}
trailer : '.' [targs] ID | '.' ('this' | new | 'super') | '(' [args] ')' | '[' expr ']' | '++' | '--' | '::' (ID | 'new')
"""

GO = r"""
file : 'package' ID ';' {'import' (imp | '(' {imp ';'} [imp] ')') ';'} {top ';'} [top]
imp : [ID | '.'] STR
top : 'func' [recv] ID [tparams] sig [block] | decl
recv : '(' [ID] type [','] ')'
decl : 'var' (vspec | '(' {vspec ';'} [vspec] ')') | 'const' (vspec | '(' {vspec ';'} [vspec] ')') | 'type' (tspec | '(' {tspec ';'} [tspec] ')')
vspec : ids [type] ['=' exprs]
tspec : ID [tparams] ['='] type
tparams : '[' ids constraint {',' ids constraint} [','] ']'
constraint : term {'|' term}
term : ['~'] type
ids : ID {',' ID}
sig : params [result]
result : type | params
params : '(' [ptype {',' ptype} [',']] ')' | '(' named {',' named} [','] ')'
ptype : ['...'] type
named : ids ['...'] type
type : ID ['.' ID] [targs] | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' ['<-'] type | '<-' 'chan' type | 'func' sig | struct | iface | '(' type ')'
targs : '[' type {',' type} [','] ']'
struct : 'struct' '{' {field ';'} [field] '}'
field : (ids type | ['*'] ID ['.' ID] [targs]) [STR]
iface : 'interface' '{' {(ID sig | constraint) ';'} [ID sig | constraint] '}'
block : '{' stmts '}'
stmts : {[stmt] ';'} [stmt]
stmt : plain | block | ID ':' [stmt] | ifs | fors | switch | select
plain : decl | simple | 'return' [exprs] | 'break' [ID] | 'continue' [ID] | 'goto' ID | 'fallthrough' | 'go' expr | 'defer' expr
simple : exprs | exprs asg exprs | expr ('++' | '--') | expr '<-' expr
asg : '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
ifs : 'if' [[simple] ';'] expr block ['else' (ifs | block)]
fors : 'for' [expr | [simple] ';' [expr] ';' [simple] | [exprs ('=' | ':=')] 'range' expr] block
switch : 'switch' [[simple] ';'] [simple] cases
cases : '{' {('case' (exprs | types) | 'default') ':' stmts} '}'
types : type {',' type}
select : 'select' comms
comms : '{' {('case' simple | 'default') ':' stmts} '}'
exprs : expr {',' expr}
expr : unary {binop unary}
binop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '>' | '>='
unary : ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary | primary
primary : operand {trailer}
operand : ID | NUM | STR | CHAR | '(' expr ')' | '(' type ')' | 'func' sig [block] | littype litval | '[' ']' type | 'map' '[' type ']' type | 'chan' ['<-'] type | struct | iface
littype : ID ['.' ID] [targs] | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | struct
litval : '{' [elem {',' elem} [',']] '}'
elem : [key ':'] key
key : expr | litval
trailer : '.' ID | '.' '(' ('type' | type) ')' | '(' [arg {',' arg} ['...'] [',']] ')' | '[' expr {',' expr} ']' | '[' [expr] ':' [expr] [':' expr] ']' | '[' type {',' type} ']'
arg : expr | type
"""

JAVASCRIPT = r"""
script : {outer}
module : {outer | import | export}
import : 'import' STR end | 'import' clause 'from' STR end
clause : ident [',' (names | '*' 'as' ident)] | names | '*' 'as' ident
names : '{' [spec {',' spec} [',']] '}'
spec : (key | STR) ['as' (key | STR)]
export : 'export' (decl | 'default' (funexp | classexp | assign end) | names ['from' STR] end | '*' ['as' (key | STR)] 'from' STR end)
end : ';' | NL | '&}'
decl : binding end | function | class
binding : ('var' | 'let') var {',' var} | 'const' const {',' const}
var : ident ['=' assign] | shape '=' assign
const : (ident | shape) '=' assign
ident : ID | 'let' | 'async' | 'static' | 'of' | 'get' | 'set' | 'from' | 'as' | 'yield' | 'await'
shape : '[' [elems] ']' | '{' [props] '}'
pattern : ident | shape
function : ['async'] 'function' ['*'] ident '(' [params] ')' body
body : '{' {stmt} '}'
params : param {',' param} [',']
param : ['...'] pattern ['=' assign]
class : 'class' ident ['extends' operand] classbody
classbody : '{' {['static'] member | ';' | NL | 'static' body} '}'
member : ['async'] ['*'] mkey '(' [params] ')' body | ('get' | 'set') mkey '(' [params] ')' body | mkey ['=' assign] end
mkey : key | STR | NUM | '[' assign ']' | '#' key
key : ident | word
word : 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'break' | 'continue' | 'switch' | 'case' | 'default' | 'throw' | 'try' | 'catch' | 'finally' | 'new' | 'delete' | 'typeof' | 'void' | 'in' | 'instanceof' | 'var' | 'const' | 'function' | 'class' | 'extends' | 'this' | 'super' | 'null' | 'true' | 'false' | 'import' | 'export' | 'with' | 'debugger' | 'enum'
outer : top end | function | class | body | ';' | NL | 'if' '(' expr ')' [NL] outer [[NL] 'else' [NL] outer] | loops | ident ':' [NL] outer
 | 'try' body (catch [finally] | finally) | 'with' '(' expr ')' [NL] outer
stmt : local end | function | class | body | ';' | NL | 'if' '(' expr ')' [NL] stmt [[NL] 'else' [NL] stmt] | loops | ident ':' [NL] stmt
 | 'try' body (catch [finally] | finally) | 'with' '(' expr ')' [NL] stmt
top : plain | binding
local : plain | binding | 'break' [ident] | 'continue' [ident]
plain : start | 'return' [expr] | 'throw' expr | 'debugger'
start : expr
loops : 'while' '(' expr ')' [NL] stmt | 'do' [NL] stmt [NL] 'while' '(' expr ')' [';' | NL]
 | 'for' ['await'] '(' [forinit] ';' [expr] ';' [expr] ')' [NL] stmt | 'for' ['await'] '(' (('var' | 'let' | 'const') pattern | operand) ('in' | 'of') expr ')' [NL] stmt
 | 'switch' '(' expr ')' cases
cases : '{' {[NL] ('case' expr | 'default') ':' {stmt}} '}'
catch : [NL] 'catch' ['(' pattern ')'] body
finally : [NL] 'finally' body
forinit : binding | expr
expr : assign {',' assign}
assign : arrow | 'yield' ['*'] [assign] | operand {binop operand} ['?' assign ':' assign] | place asg assign
asg : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
arrow : ['async'] (ident | '(' [params] ')') '=>' (body | assign)
binop : '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '&&' | '||' | '??' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '>>>' | 'in' | 'instanceof'
operand : ('+' | '-' | '++' | '--' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await') operand | place | value {trailer} | '#' ID
place : root {trailer}
root : ident | 'this' | 'super' | '(' expr ')' | '[' [elems] ']' | '{' [props] '}' | 'new' '.' ID | 'new' made [args] | 'import' ('(' assign [',' assign] ')' | '.' ID)
made : (root2 | value | 'new' made args) {'.' (key | '#' key) | '[' expr ']' | TPL}
root2 : ident | 'this' | 'super' | '(' expr ')' | '[' [elems] ']' | 'new' '.' ID | 'import' '.' ID
value : NUM | STR | TPL | REGEX | 'null' | 'true' | 'false' | funexp | classexp
funexp : ['async'] 'function' ['*'] [ident] '(' [params] ')' body
classexp : 'class' [ident] ['extends' operand] classbody
elems : [elem] {',' [elem]}
elem : ['...'] assign
props : prop {',' prop} [',']
prop : ['async'] ['*'] mkey '(' [params] ')' body | ('get' | 'set') mkey '(' [params] ')' body | mkey ':' assign | ident ['=' assign] | '...' assign
trailer : '.' (key | '#' key) | '?.' (key | '#' key | args | '[' expr ']' | TPL) | args | '[' expr ']' | '++' | '--' | TPL
args : '(' [arg {',' arg} [',']] ')'
arg : ['...'] assign
"""

CPP = r"""
cpp : {decl}
decl : 'using' 'namespace' qid ';' | 'using' ID {attr} '=' typeid ';' | 'using' using {',' using} ';' | 'using' 'enum' qid ';' | ['inline'] 'namespace' {attr} [qid] space | 'namespace' ID '=' qid ';'
 | 'extern' STR (space | decl) | 'template' '<' [tparam {',' tparam}] '>' [needs] (decl | 'concept' ID '=' expr ';') | 'extern' 'template' decl | 'template' decl
 | 'static_assert' '(' args ')' ';' | function | simple ';' | ';'
using : ['typename'] qid ['...']
space : '{' {decl} '}'
attr : '[' '[' {anytok} ']' ']' | 'alignas' '(' args ')'
anytok : ID | STR | NUM | '(' {anytok} ')' | ',' | '::' | ':' | 'using'
needs : 'requires' need {('&&' | '||') need}
need : '(' expr ')' | requires | qid | 'true' | 'false'
requires : 'requires' ['(' [params] ')'] '{' {req} '}'
req : expr ';' | 'typename' qid ';' | '{' expr '}' ['noexcept'] ['->' typeid] ';' | 'requires' expr ';'
tparam : ('typename' | 'class') ['...'] [ID] ['=' typeid] | 'template' '<' [tparam {',' tparam}] '>' ('class' | 'typename') ['...'] [ID] ['=' qid] | param | qid ['...'] [ID] ['=' typeid]
function : {attr | fspec} [type] header [ctorinit] (body | 'try' body catch {catch}) | {attr | fspec} [type] header '=' ('default' | 'delete') ';'
header : {ptr} (qid | '(' declarator ')') called {suffix} [needs]
fspec : 'inline' | 'static' | 'virtual' | 'explicit' ['(' expr ')'] | 'constexpr' | 'friend' | 'extern' | 'consteval' | 'constinit'
ctorinit : ':' cinit {',' cinit}
cinit : qid ('(' [args] ')' | braces) ['...']
simple : {attr | fspec} type idecl {',' idecl} | {attr | fspec | qual} (class | enum) | 'typedef' type declarator {',' declarator} | {attr | fspec} header
local : {attr | fspec} type idecl {',' idecl} | {attr | fspec | qual} (class | enum) | 'typedef' type declarator {',' declarator} | expr | 'return' [init] | 'break' | 'continue' | 'goto' ID
 | 'using' 'namespace' qid | 'using' ID '=' typeid | 'using' using | 'using' 'enum' qid | 'static_assert' '(' args ')' | 'co_return' [init] | 'co_yield' init | 'namespace' ID '=' qid
idecl : declarator [':' expr] ['=' init | braces | '(' args ')']
init : expr | braces
braces : '{' [binit {',' binit} [',']] '}'
binit : '.' ID ('=' init | braces) | init ['...'] | '[' expr ']' '=' init
type : {qual} core {qual}
qual : 'const' | 'volatile' | 'mutable' | 'register' | 'static' | 'constexpr' | 'thread_local' | 'inline' | 'extern'
core : fund | ['typename'] qid | [qid] 'auto' | 'decltype' '(' (expr | 'auto') ')' | class | enum
fund : word {sized} | sized {sized | 'const'} [word {sized}]
word : 'int' | 'char' | 'bool' | 'double' | 'float' | 'void' | 'wchar_t' | 'char8_t' | 'char16_t' | 'char32_t'
sized : 'unsigned' | 'signed' | 'long' | 'short'
class : ('class' | 'struct' | 'union') {attr} [qid] ['final'] [':' basecls {',' basecls}] members | ('class' | 'struct' | 'union') {attr} qid
members : '{' {decl | {qual} (fund | qid) ':' expr ';' | ('public' | 'private' | 'protected') [ID] ':'} '}'
basecls : {'public' | 'private' | 'protected' | 'virtual'} qid ['...']
enum : 'enum' ['class' | 'struct'] {attr} [qid] [':' type] '{' [enumer {',' enumer} [',']] '}' | 'enum' ['class' | 'struct'] qid [':' type]
enumer : ID {attr} ['=' expr]
qid : ['::'] qpart {'::' ['template'] qpart}
qpart : ID [targs] | '~' ID | 'operator' oper | 'final' | 'override' | 'restrict'
targs : '<' [targ {',' targ}] '>'
targ : typeid ['...'] | expr ['...']
typeid : type {ptr} {suffix}
ptr : ('*' | '&' | '&&' | qid '::' '*') {'const' | 'volatile' | 'restrict'}
declarator : {ptr} ['...'] dcore {suffix}
dcore : qid | '(' declarator ')' | '[' ID {',' ID} ']'
suffix : '[' [expr] ']' | called
called : '(' [params] ')' {'const' | 'noexcept' ['(' expr ')'] | 'throw' '(' [typeid {',' typeid}] ')' | 'override' | 'final' | '&' | '&&' | 'volatile'} ['->' typeid]
params : param {',' param} [[','] '...'] | '...'
param : {attr} ['this'] type {ptr} ['...'] [dcore | '(' {ptr} [qid] ')'] {suffix} ['=' init]
oper : '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '~' | '!' | '=' | '<' | '>' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<' | '<<=' | '>' '>' | '>' '>=' | '==' | '!=' | '<=' | '>=' | '<=>' | '&&' | '||' | '++' | '--' | ',' | '->' | '->' '*' | '(' ')' | '[' ']' | 'new' ['[' ']'] | 'delete' ['[' ']'] | type {ptr} | STR [ID]
body : '{' {stmt} '}'
stmt : body | ';' | local ';' | 'if' ['constexpr'] '(' [sinit ';'] cond ')' stmt ['else' stmt] | 'while' '(' cond ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
 | 'for' '(' [sinit] ';' [cond] ';' [expr] ')' stmt | 'for' '(' [sinit ';'] type {ptr} dcore ':' init ')' stmt | ID ':' stmt
 | 'switch' '(' [sinit ';'] cond ')' stmt | 'case' expr ['...' expr] ':' [stmt] | 'default' ':' [stmt] | 'try' body catch {catch} | attr stmt
catch : 'catch' '(' (param | '...') ')' body
sinit : {attr | fspec} type idecl {',' idecl} | expr
cond : expr | type {ptr} dcore ('=' init | braces)
args : arg {',' arg}
arg : init ['...']
expr : assign {',' assign}
assign : operand {binop operand} ['?' [expr] ':' assign] ['=' init] | 'throw' [assign]
binop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<=>' | '<<' | '>' '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '.' '*' | '->' '*' | 'and' | 'or' | 'xor'
operand : ('+' | '-' | '++' | '--' | '!' | '~' | '*' | '&' | '&&' | 'not' | 'co_await') operand | '(' typeid ')' (operand | braces) | 'sizeof' ['...'] (operand | '(' typeid ')') | 'alignof' '(' typeid ')' | 'noexcept' '(' expr ')' | new | ['::'] 'delete' ['[' ']'] operand | primary {trailer}
new : ['::'] 'new' ['(' args ')'] (type | '(' typeid ')') {ptr} {'[' [expr] ']'} ['(' [args] ')' | braces]
primary : qid | NUM | STR {STR | ID} | CHAR | 'this' | 'true' | 'false' | 'nullptr' | '(' expr ')' | '(' expr '...' ')' | '(' fold ')' | fund ('(' [args] ')' | braces) | qid braces | lambda | requires | 'typename' qid ('(' [args] ')' | braces) | cast '<' typeid '>' '(' expr ')' | 'typeid' '(' (expr | typeid) ')' | '(' body ')' | 'decltype' '(' expr ')' [braces | '(' [args] ')']
fold : '...' binop operand | operand binop '...' [binop operand]
cast : 'static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast'
lambda : '[' [caps] ']' ['<' [tparam {',' tparam}] '>'] ['(' [params] ')'] {'mutable' | 'constexpr' | 'noexcept'} ['->' typeid] body
caps : cap {',' cap}
cap : '=' | ['&'] ['...'] ID ['=' init | braces | '...'] | '&' | ['*'] 'this'
trailer : ('.' | '->') ['template'] qid | '(' [args] ')' | '[' init ']' | '++' | '--'
c : {kdecl}
kid : ID | 'class' | 'new' | 'delete' | 'template' | 'typename' | 'namespace' | 'using' | 'public' | 'private' | 'protected' | 'virtual' | 'this' | 'try' | 'catch' | 'throw' | 'operator' | 'friend' | 'explicit' | 'mutable' | 'final' | 'override' | 'concept' | 'requires' | 'and' | 'or' | 'not' | 'xor' | 'noexcept' | 'decltype' | 'typeid' | 'co_await' | 'co_return' | 'co_yield' | 'consteval' | 'constinit' | 'static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast' | 'wchar_t' | 'char8_t' | 'char16_t' | 'char32_t'
kdecl : kfunction | ksimple ';' | ';' | 'static_assert' '(' kargs ')' ';'
kfunction : kspec kheader {kspec kdeclarator {',' kdeclarator} ';'} kbody | kid '(' [kid {',' kid}] ')' {kspec kdeclarator {',' kdeclarator} ';'} kbody
kspec : {kqual} kcore {kqual}
kqual : 'const' | 'volatile' | 'static' | 'extern' | 'inline' | 'register' | 'auto' | 'restrict' | 'thread_local' | 'constexpr' | 'alignas' '(' (kexpr | ktype) ')'
kcore : kfund | kid | ('struct' | 'union') [kid] '{' {kspec [kfield {',' kfield}] ';' | ';'} '}' | ('struct' | 'union') kid | 'enum' [kid] '{' kid ['=' kassign] {',' kid ['=' kassign]} [','] '}' | 'enum' kid
kfund : kword {sized} | sized {sized | 'const'} [kword {sized}]
kword : 'int' | 'char' | 'bool' | 'double' | 'float' | 'void'
kfield : kdeclarator [':' kassign] | ':' kassign
kdeclarator : {'*' {kqual}} (kid | '(' kdeclarator ')') {ksuffix}
kheader : {'*' {kqual}} (kid | '(' kdeclarator ')') kcalled {ksuffix}
ksuffix : '[' {kqual} [kassign | '*'] ']' | kcalled
kcalled : '(' [kparam {',' kparam} [',' '...']] ')' | '(' kid {',' kid} ')'
kparam : kspec {'*' {kqual}} [kid | '(' kparen ')'] {ksuffix}
kparen : {'*' {kqual}} [kid | '(' kparen ')'] {ksuffix}
ktype : kspec {'*' {kqual}} ['(' kparen ')'] {ksuffix}
ksimple : kspec kinit {',' kinit} | 'typedef' kspec kdeclarator {',' kdeclarator} | {kqual} (('struct' | 'union') [kid] '{' {kspec [kfield {',' kfield}] ';' | ';'} '}' | ('struct' | 'union') kid | 'enum' [kid] '{' kid ['=' kassign] {',' kid ['=' kassign]} [','] '}')
kinit : kdeclarator ['=' kvalue]
kvalue : kassign | kbraces
kbraces : '{' [kitem {',' kitem} [',']] '}'
kitem : [{'.' kid | '[' kassign ['...' kassign] ']'} '='] kvalue
kbody : '{' {kstmt} '}'
kstmt : kbody | ';' | klocal ';' | 'if' '(' kexpr ')' kstmt ['else' kstmt] | 'while' '(' kexpr ')' kstmt | 'do' kstmt 'while' '(' kexpr ')' ';' | 'for' '(' [ksimple | kexpr] ';' [kexpr] ';' [kexpr] ')' kstmt
 | kid ':' [kstmt] | 'switch' '(' kexpr ')' kstmt | 'case' kassign ['...' kassign] ':' [kstmt] | 'default' ':' [kstmt]
klocal : ksimple | kexpr | 'return' [kexpr] | 'break' | 'continue' | 'goto' kid | 'static_assert' '(' kargs ')'
kargs : kassign {',' kassign}
kexpr : kargs
kassign : koperand {kbin koperand} ['?' [kexpr] ':' kassign]
kbin : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>='
koperand : ('+' | '-' | '++' | '--' | '!' | '~' | '*' | '&' | '&&') koperand | '(' ktype ')' (koperand | kbraces) | ('sizeof' | 'alignof') (koperand | '(' ktype ')') | kprimary {ktrailer}
kprimary : kid | NUM | STR {STR | ID} | CHAR | 'true' | 'false' | 'nullptr' | '(' kexpr ')' | '(' kbody ')'
ktrailer : ('.' | '->') kid | '(' [karg {',' karg}] ')' | '[' kexpr ']' | '++' | '--'
karg : kassign | ktype
"""

PYTHON_LINE = r"""
simple : small {';' small} [';']
small : exprs | assign | target ':' expr ['=' rhs] | target aug rhs | 'pass' | 'break' | 'continue' | 'return' [exprs] | 'raise' [expr ['from' expr]] | 'global' ID {',' ID} | 'nonlocal' ID {',' ID}
 | 'del' target {',' target} [','] | 'assert' expr [',' expr] | 'import' dotted ['as' ID] {',' dotted ['as' ID]} | 'from' {'.' | '...'} dotted 'import' froms | 'from' dots 'import' froms | yield | ID ID ['[' tparams ']'] '=' expr
dots : ('.' | '...') {'.' | '...'}
dotted : ID {'.' ID}
froms : '*' | ID ['as' ID] {',' ID ['as' ID]} | '(' ID ['as' ID] {',' ID ['as' ID]} [','] ')'
assign : targets '=' (rhs | assign)
rhs : exprs | yield
yield : 'yield' [exprs] | 'yield' 'from' expr
targets : starget {',' starget} [',']
starget : ['*'] target
target : ID | atom {trail} ('.' ID | '[' slices ']') | '(' [targets] ')' | '[' [targets] ']'
aug : '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
exprs : sexpr {',' sexpr} [',']
sexpr : '*' arith | named
named : ID ':=' expr | expr
expr : 'lambda' [lparams] ':' expr | orx ['if' orx 'else' expr]
orx : notx {('and' | 'or') notx}
notx : 'not' notx | arith {cmp arith}
cmp : '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not'
arith : unary {binop unary}
binop : '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '&' | '|' | '^' | '<<' | '>>'
unary : ('+' | '-' | '~') unary | ['await'] primary
primary : atom {trail}
trail : '.' ID | '(' [args] ')' | '[' slices ']'
atom : ID | NUM | STR {STR} | BYTES {BYTES} | '...' | 'None' | 'True' | 'False' | '(' ')' | '(' yield ')' | '(' exprs ')' | '(' sexpr comps ')' | '[' [exprs] ']' | '[' sexpr comps ']' | '{' [dict] '}' | '{' exprs '}' | '{' (kv | sexpr) comps '}'
dict : ditem {',' ditem} [',']
ditem : kv | '**' arith
kv : expr ':' expr
comps : comp {comp}
comp : ['async'] 'for' ctargets 'in' orx {'if' condx}
ctargets : starget {',' starget} [',']
condx : orx | ID ':=' orx | 'lambda' [lparams] ':' condx
args : pargs [',' kargs] [','] | kargs [','] | named comps [',']
pargs : parg {',' parg}
parg : named | '*' expr
kargs : kstar {',' kstar} [',' kmap {',' kmap}] | kmap {',' kmap}
kstar : ID '=' expr | '*' expr
kmap : ID '=' expr | '**' expr
slices : slice {',' slice} [',']
slice : [expr] ':' [expr] [':' [expr]] | named | '*' arith
lparams : lpar {',' lpar} [',']
lpar : ID ['=' expr] | '*' [ID] | '**' ID | '/'
tparams : tpar {',' tpar} [',']
tpar : ['*' | '**'] ID [':' expr] ['=' expr]
params : par {',' par} [',']
par : ID [':' expr] ['=' expr] | '*' [ID [':' ['*'] expr]] | '**' ID [':' expr] | '/'
header : 'if' named | 'elif' named | 'else' | 'while' named | ['async'] 'for' targets 'in' exprs | 'try' | 'except' ['*'] [expr ['as' ID]] | 'finally' | ['async'] 'with' (withs | '(' withs [','] ')')
 | ['async'] 'def' ID ['[' tparams ']'] '(' [params] ')' ['->' exprs] | 'class' ID ['[' tparams ']'] ['(' [args] ')']
withs : with {',' with}
with : expr ['as' target]
block : header ':' [simple]
decorator : '@' named
expression : exprs | yield
case : patterns ['if' named]
patterns : orpat {',' orpat} [',']
orpat : pat {'|' pat} ['as' ID]
pat : ['-'] NUM [('+' | '-') NUM] | STR {STR} | BYTES {BYTES} | 'None' | 'True' | 'False' | ['*'] ID | ID '.' ID {'.' ID} | '(' [patterns] ')' | '[' [patterns] ']' | '{' [mpat {',' mpat} [',']] '}' | dotted '(' [cpat {',' cpat} [',']] ')'
mpat : (pat ':' orpat) | '**' ID
cpat : orpat | ID '=' orpat
"""

# Statements of a Python file from its lines. BODY: the statement on the header's own line.
PYTHON_FILE = r"""
file : {stmt}
stmt : LINE | 'if' block {'elif' block} ['else' block] | 'for' block ['else' block] | 'while' block ['else' block] | 'with' block | {'@'} def
 | 'try' block (except {except} ['else' block] ['finally' block] | 'finally' block) | 'match' INDENT 'case' block {'case' block} DEDENT
def : ('def' | 'class') block
except : 'except' block
block : INDENT stmt {stmt} DEDENT | BODY
"""
