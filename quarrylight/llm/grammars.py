"""Lexical rules and grammars of the languages whose files are checked.

The grammars state what the language definitions state, written for recognition:
operators of all precedences share a level, and what is a matter of names, types
or early errors is left open. One dialect of each language is stated: Python 3,
modules of JavaScript, TypeScript, Java, Go and strict JSON.
"""

from __future__ import annotations

# ---------------------------------------------------------------- JSON

JSON = """
Pair = STR ':' Value
Value = STR | NUM | 'true' | 'false' | 'null' | b:Elems | c:Members
Elems = (Value (',' Value)*)?
Members = (Pair (',' Pair)*)?
"""

# ---------------------------------------------------------------- Python

PYTHON = """
Simple = Small (';' Small)* ';'?
Small = Stars | Single AugOp (Yield | Stars) | (Single | p:Single1) ':' Expr ('=' (Yield | Stars))? | (Targets '=')+ (Yield | Stars) | Yield
  | 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' (Expr ('from' Expr)?)?
  | ('global' | 'nonlocal') ID (',' ID)* | 'del' Targets | 'assert' Expr (',' Expr)?
  | 'import' Dotted ('as' ID)? (',' Dotted ('as' ID)?)*
  | 'from' (('.' | '...')* Dotted | ('.' | '...')+) 'import' ('*' | p:Names | NameList)
  | 'type' ID b:TypeParams? '=' Expr
NameList = ID ('as' ID)? (',' ID ('as' ID)?)*
Names = NameList ','?
Dotted = ID ('.' ID)*
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Yield = 'yield' ('from' Expr | Stars)?
Stars = Star (',' Star)* ','?
Star = '*' Flat | Expr
Named = (ID ':=')? Expr
StarNamed = '*' Flat | Named
Expr = Flat ('if' Flat 'else' Expr)? | 'lambda' LParams? ':' Expr
Flat = Unary (BinOp Unary)*
BinOp = 'or' | 'and' | 'in' | 'not' 'in' | 'is' 'not'? | '==' | '<' | '>' | '<=' | '>=' | '!=' | '|' | '^' | '&' | '<<' | '>>'
  | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'
Unary = ('not' | '+' | '-' | '~' | 'await')* Atom Trailer*
Atom = ID | NUM | STR+ | 'None' | 'True' | 'False' | '...' | p:Paren | b:List | c:Braces
Trailer = '.' ID | p:Args | b:Subs
Paren = (Yield | Named Comp | StarNamed (',' StarNamed)* ','?)?
List = (Named Comp | StarNamed (',' StarNamed)* ','?)?
Braces = (Pair (',' Pair)* ','? | Expr ':' Expr Comp | Named Comp | StarNamed (',' StarNamed)* ','?)?
Pair = Expr ':' Expr | '**' Flat
Args = (Named Comp | ArgList ','?)?
ArgList = Given (',' Given)* (',' Kw (',' Kw)*)? (',' Kd (',' Kd)*)? | Kw (',' Kw)* (',' Kd (',' Kd)*)? | Kd (',' Kd)*
Given = Named | '*' Expr
Kw = ID '=' Expr | '*' Expr
Kd = '**' Expr | ID '=' Expr
Subs = Slice (',' Slice)* ','?
Slice = Named | '*' Flat | Expr? ':' Expr? (':' Expr?)?
Comp = ('async'? 'for' Targets 'in' Flat ('if' (ID ':=')? (Flat | 'lambda' LParams? ':' Expr))*)+
Single = ID | 'await'? Atom Trailer* ('.' ID | b:Subs)
Single1 = Single | p:Single1
Target = '*'? (Single | p:Inner | b:Inner)
Targets = Target (',' Target)* ','?
Inner = Targets?
LParams = (LPlace (',' LRest)? | LRest) ','?
LPlace = LNeed (',' LNeed)* (',' '/' (',' LNeed)*)? (',' LOpt)* | (LNeed ',')* LOpt (',' LOpt)* (',' '/' (',' LOpt)*)?
LNeed = ID
LOpt = ID '=' Expr
LRest = '*' ID (',' (LNeed | LOpt))* (',' '**' ID)? | '*' (',' (LNeed | LOpt))+ (',' '**' ID)? | '**' ID
Params = ((Place (',' Rest)? | Rest) ','?)?
Place = Need (',' Need)* (',' '/' (',' Need)*)? (',' Opt)* | (Need ',')* Opt (',' Opt)* (',' '/' (',' Opt)*)?
Need = ID (':' Expr)?
Opt = ID (':' Expr)? '=' Expr
Rest = '*' ID (':' Star)? (',' (Need | Opt))* (',' Kwargs)? | '*' (',' (Need | Opt))+ (',' Kwargs)? | Kwargs
Kwargs = '**' ID (':' Expr)?
TypeParams = TypeParam (',' TypeParam)* ','?
TypeParam = ('*' | '**')? ID (':' Expr)? ('=' Star)?
Decorator = '@' Named
If = 'if' Named ':' Simple?
Elif = 'elif' Named ':' Simple?
Else = 'else' ':' Simple?
While = 'while' Named ':' Simple?
For = 'async'? 'for' Targets 'in' Stars ':' Simple?
Try = 'try' ':' Simple?
Except = 'except' '*'? (Expr ('as' ID)?)? ':' Simple?
Finally = 'finally' ':' Simple?
With = 'async'? 'with' (Item (',' Item)* | p:Items) ':' Simple?
Item = Expr ('as' Target)?
Items = Item (',' Item)* ','?
Def = 'async'? 'def' ID b:TypeParams? p:Params ('->' Expr)? ':' Simple?
Class = 'class' ID b:TypeParams? p:Args? ':' Simple?
Match = 'match' StarNamed (',' StarNamed)* ','? ':'
Case = 'case' Pattern (',' Pattern)* ','? ('if' Named)? ':' Simple?
Pattern = '*' ID | Alt ('|' Alt)* ('as' ID)?
Alt = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | ID ('.' ID)* p:PArgs? | p:Patterns | b:Patterns | c:PMap
Patterns = (Pattern (',' Pattern)* ','?)?
PArgs = ((ID '=')? Pattern (',' (ID '=')? Pattern)* ','?)?
PMap = (PPair (',' PPair)* ','?)?
PPair = Alt ':' Pattern | '**' ID
Blocks = Block*
Block = SIMPLE | DECORATOR+ (DEF1 | DEF BODY) | DEF1 | DEF BODY | (IF1 | IF BODY) (ELIF1 | ELIF BODY)* (ELSE1 | ELSE BODY)?
  | (WHILE1 | WHILE BODY) (ELSE1 | ELSE BODY)? | WITH1 | WITH BODY
  | (TRY1 | TRY BODY) ((EXCEPT1 | EXCEPT BODY)+ (ELSE1 | ELSE BODY)? (FINALLY1 | FINALLY BODY)? | FINALLY1 | FINALLY BODY)
  | MATCH CASES
Cases = (CASE1 | CASE BODY)+
"""

# ---------------------------------------------------------------- JavaScript and TypeScript

_ECMA = """
Stmts = Stmt*
T = ';' | NL | END
Stmt = c:Stmts | ';' | NL | VarKind Binding (',' Binding)* T | Func | Decorator* Class
  | 'if' p:Expr NL? Stmt ('else' NL? Stmt)? | 'for' 'await'? p:ForHead NL? Stmt | 'while' p:Expr NL? Stmt
  | 'do' NL? Stmt NL? 'while' p:Expr T? | ('continue' | 'break') ID? T | 'return' Expr? T | 'throw' Expr T
  | 'switch' p:Expr c:Cases | 'try' c:Stmts ('catch' p:CatchParam? c:Stmts ('finally' c:Stmts)? | 'finally' c:Stmts)
  | ID ':' NL? Stmt | 'debugger' T | ExprStart T
  | 'import' (STR | (ID (',' (Space | c:Specs))? | Space | c:Specs) 'from' STR) With? T
  | 'export' ('*' ('as' (NAME | STR))? 'from' STR With? T | c:Specs ('from' STR With?)? T
    | 'default' (FuncOpt | Decorator* ClassOpt | ExprDefault T) | VarKind Binding (',' Binding)* T | Func | Decorator* Class)
  | Decorator+ 'export' 'default'? ClassOpt @STMT@
With = 'with' c:Obj
Space = '*' 'as' ID
Specs = (Spec (',' Spec)* ','?)?
Spec = @TYPEOPT@ (NAME | STR) ('as' (NAME | STR))?
VarKind = 'var' | 'let' | 'const' | 'using' | 'await' 'using'
Binding = ID @BANG@ @ANN@ ('=' Assign)? | (b:Elems | c:Obj) @ANN@ '=' Assign
Func = @FUNCMOD@ 'function' '*'? ID @TPAR@ p:Params @RET@ @BODY@
FuncOpt = 'async'? 'function' '*'? ID? @TPAR@ p:Params @RET@ @BODY@
Class = @CLASSMOD@ 'class' ID @TPAR@ ('extends' Operand @TARG@)? @IMPL@ c:ClassBody
ClassOpt = @CLASSMOD@ 'class' ID? @TPAR@ ('extends' Operand @TARG@)? @IMPL@ c:ClassBody
Decorator = '@' (ID ('.' NAME)* p:Args? | p:Expr) NL?
Expr = Assign (',' Assign)*
Assign = 'yield' ('*'? Assign)? | Arrow | Operand (AssignOp Assign | Tail)?
Tail = (BinOp Operand)+ Tern? | Tern
Tern = '?' Assign ':' Assign
Arrow = 'async'? (ID | @TPAR@ p:Params @RET@) '=>' (c:Stmts | Assign)
ExprStart = (Prefix+ Primary | Plain) Suffix* (AssignOp Assign | Tail)? (',' Assign)* | 'yield' ('*'? Assign)? (',' Assign)* | Arrow (',' Assign)*
ExprDefault = Assign
Operand = Prefix* Primary Suffix*
Prefix = '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' @PREFIX@
Primary = Plain | c:Obj | 'async'? 'function' '*'? ID? @TPAR@ p:Params @RET@ c:Stmts | Decorator* 'class' ID? @TPAR@ ('extends' Operand @TARG@)? @IMPL@ c:ClassBody
Plain = ID | NUM | STR | TEMPLATE | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | p:Expr | b:Elems | 'import' p:Args | 'import' '.' NAME | 'new' '.' NAME | PRIVATE
Suffix = '.' (NAME | PRIVATE) | '?.' (NAME | PRIVATE | p:Args | b:Expr | TEMPLATE) | p:Args | b:Expr | TEMPLATE | '++' | '--' @SUFFIX@
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
BinOp = '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '<' | '>' ('>' '>'?)? | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | '&' | '|' | '^' | 'in' | 'instanceof'
Args = ('...'? Assign (',' '...'? Assign)* ','?)?
Elems = ','* ('...'? Assign (','+ '...'? Assign)* ','*)?
Obj = (Prop (',' Prop)* ','?)?
Prop = '...' Assign | Key ':' Assign | ID ('=' Assign)? | ('async' | 'get' | 'set' | '*')* Key @TPAR@ p:Params @RET@ c:Stmts
Key = NAME | STR | NUM | b:Assign1 | PRIVATE
Assign1 = Assign
Params = (Param (',' Param)* ','?)?
Param = Decorator* @PMOD@ '...'? (ID | b:Elems | c:Obj @THIS@) @OPT@ @ANN@ ('=' Assign)?
CatchParam = (ID | b:Elems | c:Obj) @ANN@
ForHead = (VarKind Binding (',' Binding)* | Expr)? ';' Expr? ';' Expr? | (VarKind (ID | b:Elems | c:Obj) @ANN@ | Operand) ('of' Assign | 'in' Expr)
Cases = (('case' Expr | 'default') ':' Stmts)*
ClassBody = Member*
Member = ';' | NL | 'static' c:Stmts | Decorator* MemberMod* Key @MEMBERTYPE@ ('=' Assign)? T | Decorator* MemberMod* Key @MEMBEROPT@ @TPAR@ p:Params @RET@ @BODY@ @MEMBER@
MemberMod = 'static' | 'async' | 'get' | 'set' | '*' | 'accessor' @MOD@
"""

_TS_TYPES = """
Type = FnType | '|'? '&'? TyPost (('|' | '&') TyPost)* ('extends' Type '?' Type ':' Type)? | 'asserts' (ID | 'this') ('is' Type)? | (ID | 'this') 'is' Type
FnType = 'abstract'? 'new'? TPar? p:Params '=>' Type
TyPost = ('keyof' | 'readonly' | 'unique' | 'infer')* TyAtom b:TypeOpt* ('extends' TyPost)?
TypeOpt = Type?
TyAtom = ID ('.' NAME)* TArgs? | 'this' | 'null' | 'void' | 'true' | 'false' | STR | '-'? NUM | TEMPLATE | p:Type1 | b:Tuple | c:TypeBody
  | 'typeof' (ID | 'this' | 'import' p:Args) ('.' (NAME | PRIVATE))* TArgs? | 'import' p:Args ('.' NAME)* TArgs?
Type1 = Type
Tuple = (TupleElem (',' TupleElem)* ','?)?
TupleElem = '...'? (NAME '?'? ':')? '...'? Type '?'?
TArgs = '<' Type (',' Type)* '>'
TPar = '<' TParam (',' TParam)* ','? '>'
TParam = ('const' | 'in' | 'out')* ID ('extends' Type)? ('=' Type)?
Ret = ':' Type
TypeBody = (TMember (TSep+ TMember)* TSep*)? | (('+' | '-')? 'readonly')? b:Mapped (('+' | '-')? '?')? ':' Type (';' | NL)?
TSep = ';' | ',' | NL
TMember = TMod* Key '?'? Ret? | TMod* Key '?'? TPar? p:Params Ret? | 'new'? TPar? p:Params Ret? | TMod* b:Index Ret
TMod = 'readonly' | 'get' | 'set' | 'static'
Index = ID ':' Type
Mapped = ID 'in' Type ('as' Type)?
Impl = 'implements' TyPost (',' TyPost)*
TypeDecl = 'interface' ID TPar? ('extends' TyPost (',' TyPost)*)? c:TypeBody | 'type' ID TPar? '=' Type T | 'const'? 'enum' ID c:EnumBody
  | ('namespace' | 'module') ID ('.' ID)* c:Stmts | 'module' STR (c:Stmts | T) | 'global' c:Stmts
EnumBody = (EnumItem (',' EnumItem)* ','?)?
EnumItem = (NAME | STR | b:Assign1) ('=' Assign)?
Stmt2 = TypeDecl | 'declare' (VarKind Binding (',' Binding)* T | Func | Class | TypeDecl) | 'import' 'type' (ID (',' c:Specs)? | Space | c:Specs) 'from' STR T
  | 'import' 'type'? ID '=' ('require' p:Args | ID ('.' NAME)*) T
  | 'export' ('declare'? TypeDecl | 'declare' (VarKind Binding (',' Binding)* T | Func | Class) | 'default' TypeDecl | 'type' (c:Specs | '*' ('as' NAME)?) ('from' STR)? T | '=' Expr T | 'as' 'namespace' ID T)
"""

_SLOTS = {  # slot: (JavaScript, TypeScript)
    "STMT": ("", "| Stmt2"),
    "TYPEOPT": ("", "'type'?"),
    "BANG": ("", "'!'?"),
    "ANN": ("", "Ret?"),
    "TPAR": ("", "TPar?"),
    "RET": ("", "Ret?"),
    "BODY": ("c:Stmts", "(c:Stmts | T)"),
    "FUNCMOD": ("'async'?", "'async'?"),
    "CLASSMOD": ("", "'abstract'?"),
    "TARG": ("", "TArgs?"),
    "IMPL": ("", "Impl?"),
    "PREFIX": ("", "| TArgs | '<' 'const' '>'"),
    "SUFFIX": ("", "| '!' | ('as' | 'satisfies') (Type | 'const') | TArgs"),
    "PMOD": ("", "('public' | 'private' | 'protected' | 'readonly' | 'override')*"),
    "THIS": ("", "| 'this'"),
    "OPT": ("", "'?'?"),
    "MEMBERTYPE": ("", "('?' | '!')? Ret?"),
    "MEMBEROPT": ("", "'?'?"),
    "MEMBER": ("", "| MemberMod* b:Index Ret T"),
    "MOD": ("", "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'"),
}


def _ecma(which: int) -> str:
    text = _ECMA + (_TS_TYPES if which else "")
    for slot, forms in _SLOTS.items():
        text = text.replace(f"@{slot}@", forms[which])
    return text


JAVASCRIPT, TYPESCRIPT = _ecma(0), _ecma(1)

# ---------------------------------------------------------------- Java

JAVA = """
Package = Annot* 'package' Name ';'
Import = 'import' 'static'? Name ('.' '*')? ';' | 'import' 'module' Name ';'
Decl = ';'* TypeDecl ';'* | ';'+
Module = Annot* 'open'? 'module' Name c:Directives
Directives = (('requires' ('transitive' | 'static')* Name | ('exports' | 'opens') Name ('to' Name (',' Name)*)? | 'uses' Name | 'provides' Name 'with' Name (',' Name)*) ';')*
Unit = PACKAGE? IMPORT* DECL* | IMPORT* MODULE
Name = ID ('.' ID)*
Annot = '@' Name p:AnnArgs?
AnnArgs = (ID '=' AnnVal (',' ID '=' AnnVal)* | AnnVal)?
AnnVal = Expr | c:AnnList | Annot
AnnList = (AnnVal (',' AnnVal)*)? ','?
Mods = (Annot | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed')*
TypeDecl = Mods TypeCore
TypeCore = 'class' ID TPar? ('extends' Type)? ('implements' Types)? ('permits' Types)? c:Members
  | 'interface' ID TPar? ('extends' Types)? ('permits' Types)? c:Members
  | 'enum' ID ('implements' Types)? c:EnumBody | 'record' ID TPar? p:Formals ('implements' Types)? c:Members | '@' 'interface' ID c:Members
Types = Type (',' Type)*
TPar = '<' TP (',' TP)* '>'
TP = Annot* ID ('extends' Type ('&' Type)*)?
Type = Annot* (Prim | ClassType) Dims
Prim = 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double'
ClassType = ID TArgs? ('.' Annot* ID TArgs?)*
TArgs = '<' (TA (',' TA)*)? '>'
TA = Annot* '?' (('extends' | 'super') Type)? | Type
Dims = (Annot* b:Empty)*
Empty = EMPTY?
Members = Member*
Member = ';' | TypeDecl | 'static'? c:Stmts | Mods TPar? (Type | 'void') ID p:Formals Dims Throws? (c:Stmts | ('default' AnnVal)? ';') | Mods Type Vars ';'
  | Mods TPar? ID p:Formals Throws? c:Stmts | Mods ID c:Stmts
Throws = 'throws' Types
Formals = (Formal (',' Formal)*)?
Formal = Mods Type (Annot* '...')? ((ID '.')* 'this' | ID Dims)
Vars = Var (',' Var)*
Var = ID Dims ('=' VInit)?
VInit = Expr | c:ArrInit
ArrInit = (VInit (',' VInit)*)? ','?
EnumBody = (EnumConst (',' EnumConst)* ','?)? (';' Member*)? | ',' (';' Member*)?
EnumConst = Annot* ID p:Args? c:Members?
Stmts = BStmt*
BStmt = Mods Type Vars ';' | TypeDecl | Stmt
Stmt = c:Stmts | ';' | 'if' p:Expr Stmt ('else' Stmt)? | 'while' p:Expr Stmt | 'do' Stmt 'while' p:Expr ';' | 'for' p:ForHead Stmt
  | 'switch' p:Expr c:Switch | 'try' p:Resources c:Stmts Catch* Finally? | 'try' c:Stmts (Catch+ Finally? | Finally)
  | 'return' Expr? ';' | 'throw' Expr ';' | ('break' | 'continue') ID? ';' | 'yield' Expr ';' | 'synchronized' p:Expr c:Stmts
  | 'assert' Expr (':' Expr)? ';' | ID ':' Stmt | StmtExpr ';'
Catch = 'catch' p:CatchFormal c:Stmts
Finally = 'finally' c:Stmts
CatchFormal = Mods Type ('|' Type)* ID
StmtExpr = Operand AssignOp Expr | ('++' | '--') Operand | Operand ('++' | '--') | Primary? Suffix* Call | 'new' Creator
Call = p:Args
ForHead = (Mods Type Vars | StmtExpr (',' StmtExpr)*)? ';' Expr? ';' (StmtExpr (',' StmtExpr)*)? | Mods Type ID ':' Expr
Resources = Resource (';' Resource)* ';'?
Resource = Mods Type ID '=' Expr | Operand
Switch = (('case' CaseItem (',' CaseItem)* ('when' Expr)? | 'default') (':' Stmts | '->' (Expr ';' | c:Stmts | 'throw' Expr ';')))*
CaseItem = Expr | Pattern | 'default'
Pattern = Mods Type ID | ClassType p:Patterns ID?
Patterns = (Pattern (',' Pattern)*)?
Expr = Lambda | Operand (AssignOp Expr | Tail)?
Tail = (BinOp (Operand | Lambda) | 'instanceof' ('final'? Type ID? | Pattern))+ Tern? | Tern
Tern = '?' Expr ':' Expr
Lambda = (ID | p:LParams) '->' (c:Stmts | Expr)
LParams = (ID (',' ID)*)? | Formals
Operand = ('+' | '-' | '!' | '~' | '++' | '--' | p:Cast)* Primary Suffix* | p:Cast Lambda
Cast = Type ('&' Type)*
Primary = NUM | STR | CHAR | 'true' | 'false' | 'null' | ID | 'this' | 'super' | p:Expr | 'new' Creator | Prim Dims ('.' 'class' | '::' 'new') | 'void' '.' 'class'
  | 'switch' p:Expr c:Switch | ID TArgs ('.' ID TArgs?)* Dims '::' TArgs? (ID | 'new')
Suffix = '.' TArgs? ID | '.' ('class' | 'this' | 'super' | 'new' Creator) | p:Args | b:Expr | b:Empty | '::' TArgs? (ID | 'new') | '++' | '--'
Creator = Annot* ClassType (p:Args c:Members? | (b:Expr | b:Empty)+ c:ArrInit?) | Annot* Prim (b:Expr | b:Empty)+ c:ArrInit? | TArgs ClassType p:Args c:Members?
Args = (Expr (',' Expr)*)?
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>='
BinOp = '+' | '-' | '*' | '/' | '%' | '<<' | '<' | '>' ('>' '>'?)? | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^'
"""

# ---------------------------------------------------------------- Go

GO = """
Package = 'package' ID (';' | END)
Import = 'import' (ImpSpec | p:ImpSpecs) (';' | END)
ImpSpec = (ID | '.')? STR
ImpSpecs = (ImpSpec (';' ImpSpec)* ';'?)?
Decl = (Func | Gen) (';' | END) | ';'
Unit = PACKAGE IMPORT* DECL*
Gen = 'const' (CSpec | p:CSpecs) | 'var' (VSpec | p:VSpecs) | 'type' (TSpec | p:TSpecs)
CSpec = Ids (Type? '=' Exprs)?
CSpecs = (CSpec (';' CSpec)* ';'?)?
VSpec = Ids (Type ('=' Exprs)? | '=' Exprs)
VSpecs = (VSpec (';' VSpec)* ';'?)?
TSpec = ID b:TPars? '='? Type
TSpecs = (TSpec (';' TSpec)* ';'?)?
TPars = Ids Constraint (',' Ids Constraint)* ','?
Constraint = '~'? Type ('|' '~'? Type)*
Ids = ID (',' ID)*
Func = 'func' p:Params? ID b:TPars? p:Params Result? c:Stmts?
Params = (PDecl (',' PDecl)* ','?)?
PDecl = ID? '...'? Type
Result = p:Params | Type
Type = TName | p:Type1 | '*' Type | b:ArrLen Type | 'map' b:Type1 Type | '<-'? 'chan' '<-'? Type | 'func' p:Params Result? | 'struct' c:Fields | 'interface' c:Iface
Type1 = Type
ArrLen = (Expr | '...')?
TName = ID ('.' ID)? b:TypeList?
TypeList = Type (',' Type)* ','?
Fields = (Field (';' Field)* ';'?)?
Field = Ids Type STR? | '*'? TName STR?
Iface = (IElem (';' IElem)* ';'?)?
IElem = ID p:Params Result? | Constraint
Stmts = Stmt ? (';' Stmt?)* END?
Stmt = Gen | ID ':' Stmt? | SimpleStmt | ('go' | 'defer') Expr | 'return' Exprs? | ('break' | 'continue') ID? | 'goto' ID | 'fallthrough' | c:Stmts | If
  | 'switch' (SimpleStmt? ';')? SimpleStmt? c:Cases | 'select' c:Cases
  | 'for' (Expr | SimpleStmt? ';' Expr? ';' SimpleStmt? | (Exprs ('=' | ':='))? 'range' Expr)? c:Stmts
If = 'if' (SimpleStmt? ';')? Expr c:Stmts ('else' (If | c:Stmts))?
SimpleStmt = Exprs (('=' | ':=' | OpAssign) Exprs | '++' | '--' | '<-' Expr)?
OpAssign = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
Cases = (('case' CaseHead | 'default') ':' Stmts)*
CaseHead = (Expr | Type) (',' (Expr | Type))* | Exprs ('=' | ':=') Expr | Expr '<-' Expr
Exprs = Expr (',' Expr)*
Expr = Unary (BinOp Unary)*
BinOp = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
Unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* Primary Suffix*
Primary = NUM | STR | CHAR | ID | p:Expr1 | p:Type1 | 'func' p:Params Result? c:Stmts | LitType (c:LitVal | p:Args)
Expr1 = Expr
LitType = b:ArrLen Type | 'map' b:Type1 Type | 'struct' c:Fields | 'interface' c:Iface | '<-'? 'chan' '<-'? Type | 'func' p:Params Result?
Suffix = '.' ID | '.' p:Assert | b:Index | p:Args | c:LitVal
Assert = Type | 'type'
Index = Expr | Expr? ':' Expr? (':' Expr)? | TypeList
Args = (Arg '...'? (',' Arg '...'?)* ','?)?
Arg = Expr | Type
LitVal = (Elem (',' Elem)* ','?)?
Elem = (ElemVal ':')? ElemVal
ElemVal = Expr | c:LitVal
"""
