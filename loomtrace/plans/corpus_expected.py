"""Rows of the fact queries on the fixed corpus: recorded from a run, then reviewed against its scripts."""

EXPECTED: dict[str, str] = {
    "q_t1_statements": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("kind" AS VARCHAR) AS "kind", CAST("target" AS VARCHAR) AS "target", CAST("category" AS VARCHAR) AS "category", CAST("model_status" AS VARCHAR) AS "model_status", CAST("syntax_status" AS VARCHAR) AS "syntax_status", CAST("partition_mode" AS VARCHAR) AS "partition_mode", CAST("session_scoped" AS BOOLEAN) AS "session_scoped", CAST("write_ordinal" AS INTEGER) AS "write_ordinal", CAST("overwrite_mode" AS VARCHAR) AS "overwrite_mode", CAST("overwrite_mode_source" AS VARCHAR) AS "overwrite_mode_source" FROM (VALUES
        ('daily', 'stmt:001', 'OTHER', '', 'control_statement', 'ignored', 'strict_ok', 'none', FALSE, NULL, NULL, NULL),
        ('daily', 'stmt:002', 'CTAS', 'recent', 'projection_write', 'modeled', 'strict_ok', 'none', TRUE, 1, NULL, NULL),
        ('daily', 'stmt:003', 'CTAS', 'counted', 'projection_write', 'modeled', 'strict_ok', 'none', TRUE, 2, NULL, NULL),
        ('daily', 'stmt:004', 'EMPTY', '', 'empty_statement', 'ignored', 'strict_ok', 'none', FALSE, NULL, NULL, NULL),
        ('daily', 'stmt:005', 'INSERT_OVERWRITE', 'mart.customer_daily', 'projection_write', 'modeled', 'strict_ok', 'static', FALSE, 3, 'dynamic', 'observed'),
        ('daily', 'stmt:006', 'INSERT', 'mart.all_keys', 'projection_write', 'modeled', 'strict_ok', 'none', FALSE, 4, NULL, NULL),
        ('daily', 'stmt:007', 'INSERT', 'mart.all_keys', 'projection_write', 'modeled', 'strict_ok', 'none', FALSE, 5, NULL, NULL),
        ('daily', 'stmt:008', 'COMMENT', '', 'empty_statement', 'ignored', 'strict_ok', 'none', FALSE, NULL, NULL, NULL),
        ('revenue', 'stmt:001', 'INSERT_OVERWRITE', 'mart.revenue_by_segment', 'projection_write', 'modeled', 'strict_ok', 'none', FALSE, 1, 'static', 'assumed_default'),
        ('upkeep', 'stmt:001', 'MERGE', 'mart.balance', 'conditional_write', 'modeled', 'strict_ok', 'none', FALSE, 1, NULL, NULL),
        ('upkeep', 'stmt:002', 'UPDATE', 'mart.balance', 'row_mutation', 'modeled', 'strict_ok', 'none', FALSE, 2, NULL, NULL),
        ('upkeep', 'stmt:003', 'DELETE', 'mart.balance', 'row_mutation', 'modeled', 'strict_ok', 'none', FALSE, 3, NULL, NULL),
        ('upkeep', 'stmt:004', 'TRUNCATE', 'mart.staging', 'row_mutation', 'modeled', 'strict_ok', 'none', FALSE, 4, NULL, NULL),
        ('upkeep', 'stmt:005', 'CTAS', 'mart.latest', 'projection_write', 'modeled', 'strict_ok', 'none', FALSE, 5, NULL, NULL),
        ('upkeep', 'stmt:006', 'INSERT', 'mart.guess', 'projection_write', 'modeled', 'strict_ok', 'none', FALSE, 6, NULL, NULL),
        ('upkeep', 'stmt:007', 'INSERT', 'mart.wide', 'projection_write', 'modeled', 'strict_ok', 'none', FALSE, 7, NULL, NULL),
        ('upkeep', 'stmt:008', 'OTHER', '', 'unsupported_statement', 'unsupported', 'strict_ok', 'none', FALSE, NULL, NULL, NULL),
        ('upkeep', 'stmt:009', 'FAILED', '', 'unsupported_statement', 'failed', 'failed', 'none', FALSE, NULL, NULL, NULL)
    ) v("task", "stmt", "kind", "target", "category", "model_status", "syntax_status", "partition_mode", "session_scoped", "write_ordinal", "overwrite_mode", "overwrite_mode_source")""",
    "q_x1_scope_graph": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("upstream" AS VARCHAR) AS "upstream", CAST("downstream" AS VARCHAR) AS "downstream" FROM (VALUES
        ('daily', 'stmt:006', 'union:main', 'ROOT'),
        ('daily', 'stmt:006', 'union:main:b00', 'union:main'),
        ('daily', 'stmt:006', 'union:main:b01', 'union:main'),
        ('revenue', 'stmt:001', 'cte:priced', 'ROOT'),
        ('upkeep', 'stmt:001', 'subq:s', 'ROOT'),
        ('upkeep', 'stmt:005', 'subq:q', 'ROOT')
    ) v("task", "stmt", "upstream", "downstream")""",
    "q_x1_scopes": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("kind" AS VARCHAR) AS "kind", CAST("role" AS VARCHAR) AS "role", CAST("is_distinct" AS BOOLEAN) AS "is_distinct", CAST("set_op" AS VARCHAR) AS "set_op", CAST("has_star" AS BOOLEAN) AS "has_star" FROM (VALUES
        ('daily', 'stmt:002', 'ROOT', 'root', 'filter', FALSE, NULL, FALSE),
        ('daily', 'stmt:003', 'ROOT', 'root', 'aggregate', FALSE, NULL, FALSE),
        ('daily', 'stmt:005', 'ROOT', 'root', 'join', FALSE, NULL, FALSE),
        ('daily', 'stmt:006', 'ROOT', 'root', 'pass_through', FALSE, 'UNION_ALL', FALSE),
        ('daily', 'stmt:006', 'union:main', 'union', 'union', FALSE, 'UNION_ALL', FALSE),
        ('daily', 'stmt:006', 'union:main:b00', 'union_branch', 'union_branch', FALSE, NULL, FALSE),
        ('daily', 'stmt:006', 'union:main:b01', 'union_branch', 'union_branch', FALSE, NULL, FALSE),
        ('daily', 'stmt:007', 'ROOT', 'root', 'pass_through', FALSE, NULL, FALSE),
        ('revenue', 'stmt:001', 'ROOT', 'root', 'aggregate', FALSE, NULL, FALSE),
        ('revenue', 'stmt:001', 'cte:priced', 'cte', 'filter', FALSE, NULL, FALSE),
        ('upkeep', 'stmt:001', 'ROOT', 'root', 'transform', FALSE, NULL, FALSE),
        ('upkeep', 'stmt:001', 'subq:s', 'subquery', 'pass_through', FALSE, NULL, FALSE),
        ('upkeep', 'stmt:002', 'ROOT', 'root', 'filter', FALSE, NULL, FALSE),
        ('upkeep', 'stmt:003', 'ROOT', 'root', 'filter', FALSE, NULL, FALSE),
        ('upkeep', 'stmt:005', 'ROOT', 'root', 'filter', FALSE, NULL, FALSE),
        ('upkeep', 'stmt:005', 'subq:q', 'subquery', 'dedup', FALSE, NULL, FALSE),
        ('upkeep', 'stmt:006', 'ROOT', 'root', 'join', FALSE, NULL, FALSE),
        ('upkeep', 'stmt:007', 'ROOT', 'root', 'pass_through', FALSE, NULL, TRUE)
    ) v("task", "stmt", "scope", "kind", "role", "is_distinct", "set_op", "has_star")""",
    "q_x3_end_to_end": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("column" AS VARCHAR) AS "column", CAST("source_kind" AS VARCHAR) AS "source_kind", CAST("trace_complete" AS BOOLEAN) AS "trace_complete", CAST("physical" AS VARCHAR) AS "physical", CAST("rowsets" AS VARCHAR) AS "rowsets", CAST("generated" AS VARCHAR) AS "generated", CAST("window_context" AS VARCHAR) AS "window_context", CAST("candidates" AS VARCHAR) AS "candidates", CAST("reasons" AS VARCHAR) AS "reasons" FROM (VALUES
        ('daily', 'stmt:002', 'o_custkey', 'physical', TRUE, 'orders.o_custkey', '', '', '', '', ''),
        ('daily', 'stmt:002', 'o_orderkey', 'physical', TRUE, 'orders.o_orderkey', '', '', '', '', ''),
        ('daily', 'stmt:002', 'o_totalprice', 'physical', TRUE, 'orders.o_totalprice', '', '', '', '', ''),
        ('daily', 'stmt:003', 'best', 'physical', TRUE, 'recent.o_totalprice', '', '', '', '', ''),
        ('daily', 'stmt:003', 'k', 'physical', TRUE, 'recent.o_custkey', '', '', '', '', ''),
        ('daily', 'stmt:003', 'n', 'rowset', TRUE, '', 'recent', '', '', '', ''),
        ('daily', 'stmt:005', 'c_custkey', 'physical', TRUE, 'customer.c_custkey', '', '', '', '', ''),
        ('daily', 'stmt:005', 'c_name', 'physical', TRUE, 'customer.c_name', '', '', '', '', ''),
        ('daily', 'stmt:005', 'n', 'physical', TRUE, 'counted.n', '', '', '', '', ''),
        ('daily', 'stmt:006', 'k', 'physical', TRUE, 'customer.c_custkey,supplier.s_suppkey', '', '', '', '', ''),
        ('daily', 'stmt:007', 'l_partkey', 'physical', TRUE, 'lineitem.l_partkey', '', '', '', '', ''),
        ('revenue', 'stmt:001', 'c_mktsegment', 'physical', TRUE, 'customer.c_mktsegment', '', '', '', '', ''),
        ('revenue', 'stmt:001', 'revenue', 'physical', TRUE, 'lineitem.l_discount,lineitem.l_extendedprice', '', '', '', '', ''),
        ('upkeep', 'stmt:001', 'amount', 'physical', TRUE, 'customer.c_acctbal,mart.balance.amount', '', '', '', '', ''),
        ('upkeep', 'stmt:001', 'id', 'physical', TRUE, 'customer.c_custkey', '', '', '', '', ''),
        ('upkeep', 'stmt:002', 'amount', 'generated', TRUE, '', '', '0', '', '', ''),
        ('upkeep', 'stmt:005', 'event_type', 'physical', TRUE, 'events.event_type', '', '', '', '', ''),
        ('upkeep', 'stmt:005', 'user_id', 'physical', TRUE, 'events.user_id', '', '', '', '', ''),
        ('upkeep', 'stmt:006', 'label', 'physical', TRUE, 'somewhere.label', '', '', '', '', ''),
        ('upkeep', 'stmt:006', 'name', 'unresolved', FALSE, '', '', '', '', 'elsewhere.name,somewhere.name', 'ambiguous_unqualified'),
        ('upkeep', 'stmt:007', '*', 'unresolved', FALSE, '', '', '', '', '', 'star_not_expanded')
    ) v("task", "stmt", "column", "source_kind", "trace_complete", "physical", "rowsets", "generated", "window_context", "candidates", "reasons")""",
    "q_x1_column_sources": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("column" AS VARCHAR) AS "column", CAST("transform" AS VARCHAR) AS "transform", CAST("ord" AS INTEGER) AS "ord", CAST("src_scope" AS VARCHAR) AS "src_scope", CAST("src_column" AS VARCHAR) AS "src_column", CAST("role" AS VARCHAR) AS "role", CAST("src_path" AS VARCHAR) AS "src_path" FROM (VALUES
        ('daily', 'stmt:002', 'ROOT', 'o_custkey', 'DIRECT', 0, 'orders', 'o_custkey', 'value', ''),
        ('daily', 'stmt:002', 'ROOT', 'o_orderkey', 'DIRECT', 0, 'orders', 'o_orderkey', 'value', ''),
        ('daily', 'stmt:002', 'ROOT', 'o_totalprice', 'DIRECT', 0, 'orders', 'o_totalprice', 'value', ''),
        ('daily', 'stmt:003', 'ROOT', 'best', 'AGGREGATE', 0, 'recent', 'o_totalprice', 'value', ''),
        ('daily', 'stmt:003', 'ROOT', 'k', 'DIRECT', 0, 'recent', 'o_custkey', 'value', ''),
        ('daily', 'stmt:003', 'ROOT', 'n', 'AGGREGATE', 0, 'recent', '*', 'value', ''),
        ('daily', 'stmt:005', 'ROOT', 'c_custkey', 'DIRECT', 0, 'customer', 'c_custkey', 'value', ''),
        ('daily', 'stmt:005', 'ROOT', 'c_name', 'DIRECT', 0, 'customer', 'c_name', 'value', ''),
        ('daily', 'stmt:005', 'ROOT', 'n', 'EXPRESSION', 0, 'counted', 'n', 'value', ''),
        ('daily', 'stmt:006', 'ROOT', 'k', 'DIRECT', 0, 'union:main', 'k', 'value', ''),
        ('daily', 'stmt:006', 'union:main', 'k', 'UNION', 0, 'union:main:b00', 'k', 'value', ''),
        ('daily', 'stmt:006', 'union:main', 'k', 'UNION', 1, 'union:main:b01', 's_suppkey', 'value', ''),
        ('daily', 'stmt:006', 'union:main:b00', 'k', 'DIRECT', 0, 'customer', 'c_custkey', 'value', ''),
        ('daily', 'stmt:006', 'union:main:b01', 's_suppkey', 'DIRECT', 0, 'supplier', 's_suppkey', 'value', ''),
        ('daily', 'stmt:007', 'ROOT', 'l_partkey', 'DIRECT', 0, 'lineitem', 'l_partkey', 'value', ''),
        ('revenue', 'stmt:001', 'ROOT', 'c_mktsegment', 'DIRECT', 0, 'customer', 'c_mktsegment', 'value', ''),
        ('revenue', 'stmt:001', 'ROOT', 'revenue', 'AGGREGATE', 0, 'cte:priced', 'net', 'value', ''),
        ('revenue', 'stmt:001', 'cte:priced', 'l_orderkey', 'DIRECT', 0, 'lineitem', 'l_orderkey', 'value', ''),
        ('revenue', 'stmt:001', 'cte:priced', 'net', 'EXPRESSION', 0, 'lineitem', 'l_extendedprice', 'value', ''),
        ('revenue', 'stmt:001', 'cte:priced', 'net', 'EXPRESSION', 1, 'lineitem', 'l_discount', 'value', ''),
        ('upkeep', 'stmt:001', 'ROOT', 'amount', 'DIRECT', 0, 'subq:s', 'amount', 'value', ''),
        ('upkeep', 'stmt:001', 'ROOT', 'amount', 'EXPRESSION', 0, 'mart.balance', 'amount', 'value', ''),
        ('upkeep', 'stmt:001', 'ROOT', 'amount', 'EXPRESSION', 1, 'subq:s', 'amount', 'value', ''),
        ('upkeep', 'stmt:001', 'ROOT', 'id', 'DIRECT', 0, 'subq:s', 'id', 'value', ''),
        ('upkeep', 'stmt:001', 'subq:s', 'amount', 'DIRECT', 0, 'customer', 'c_acctbal', 'value', ''),
        ('upkeep', 'stmt:001', 'subq:s', 'id', 'DIRECT', 0, 'customer', 'c_custkey', 'value', ''),
        ('upkeep', 'stmt:002', 'ROOT', 'amount', 'CONSTANT', 0, 'CONSTANT', '0', 'value', ''),
        ('upkeep', 'stmt:005', 'ROOT', 'event_type', 'DIRECT', 0, 'subq:q', 'event_type', 'value', ''),
        ('upkeep', 'stmt:005', 'ROOT', 'user_id', 'DIRECT', 0, 'subq:q', 'user_id', 'value', ''),
        ('upkeep', 'stmt:005', 'subq:q', 'event_type', 'DIRECT', 0, 'events', 'event_type', 'value', ''),
        ('upkeep', 'stmt:005', 'subq:q', 'rn', 'WINDOW', 0, 'events', '*', 'value', ''),
        ('upkeep', 'stmt:005', 'subq:q', 'rn', 'WINDOW', 1, 'events', 'user_id', 'partition', ''),
        ('upkeep', 'stmt:005', 'subq:q', 'rn', 'WINDOW', 2, 'events', 'ts', 'order', ''),
        ('upkeep', 'stmt:005', 'subq:q', 'user_id', 'DIRECT', 0, 'events', 'user_id', 'value', ''),
        ('upkeep', 'stmt:006', 'ROOT', 'label', 'DIRECT', 0, 'somewhere', 'label', 'value', ''),
        ('upkeep', 'stmt:006', 'ROOT', 'name', 'DIRECT', 0, 'AMBIGUOUS', 'name', 'value', ''),
        ('upkeep', 'stmt:006', 'ROOT', 'name', 'DIRECT', 1, 'elsewhere', 'name', 'candidate', ''),
        ('upkeep', 'stmt:006', 'ROOT', 'name', 'DIRECT', 2, 'somewhere', 'name', 'candidate', ''),
        ('upkeep', 'stmt:007', 'ROOT', '*', 'EXPAND_ALL', 0, 'somewhere', '*', 'value', '')
    ) v("task", "stmt", "scope", "column", "transform", "ord", "src_scope", "src_column", "role", "src_path")""",
    "q_x9_inputs": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("ord" AS INTEGER) AS "ord", CAST("alias" AS VARCHAR) AS "alias", CAST("source" AS VARCHAR) AS "source", CAST("source_type" AS VARCHAR) AS "source_type", CAST("position" AS VARCHAR) AS "position" FROM (VALUES
        ('daily', 'stmt:002', 'ROOT', 0, 'orders', 'orders', 'table', 'from'),
        ('daily', 'stmt:003', 'ROOT', 0, 'recent', 'recent', 'table', 'from'),
        ('daily', 'stmt:005', 'ROOT', 0, 'c', 'customer', 'table', 'from'),
        ('daily', 'stmt:005', 'ROOT', 1, 't', 'counted', 'table', 'join'),
        ('daily', 'stmt:006', 'ROOT', 0, 'union:main', 'union:main', 'scope', 'from'),
        ('daily', 'stmt:006', 'union:main', 0, 'union:main:b00', 'union:main:b00', 'scope', 'union'),
        ('daily', 'stmt:006', 'union:main', 1, 'union:main:b01', 'union:main:b01', 'scope', 'union'),
        ('daily', 'stmt:006', 'union:main:b00', 0, 'customer', 'customer', 'table', 'from'),
        ('daily', 'stmt:006', 'union:main:b01', 0, 'supplier', 'supplier', 'table', 'from'),
        ('daily', 'stmt:007', 'ROOT', 0, 'lineitem', 'lineitem', 'table', 'from'),
        ('revenue', 'stmt:001', 'ROOT', 0, 'p', 'cte:priced', 'scope', 'from'),
        ('revenue', 'stmt:001', 'ROOT', 1, 'o', 'orders', 'table', 'join'),
        ('revenue', 'stmt:001', 'ROOT', 2, 'c', 'customer', 'table', 'join'),
        ('revenue', 'stmt:001', 'cte:priced', 0, 'lineitem', 'lineitem', 'table', 'from'),
        ('upkeep', 'stmt:001', 'ROOT', 0, 't', 'mart.balance', 'table', 'target'),
        ('upkeep', 'stmt:001', 'ROOT', 1, 's', 'subq:s', 'scope', 'using'),
        ('upkeep', 'stmt:001', 'subq:s', 0, 'customer', 'customer', 'table', 'from'),
        ('upkeep', 'stmt:002', 'ROOT', 0, 'balance', 'mart.balance', 'table', 'target'),
        ('upkeep', 'stmt:003', 'ROOT', 0, 'balance', 'mart.balance', 'table', 'target'),
        ('upkeep', 'stmt:005', 'ROOT', 0, 'q', 'subq:q', 'scope', 'from'),
        ('upkeep', 'stmt:005', 'subq:q', 0, 'events', 'events', 'table', 'from'),
        ('upkeep', 'stmt:006', 'ROOT', 0, 'x', 'somewhere', 'table', 'from'),
        ('upkeep', 'stmt:006', 'ROOT', 1, 'y', 'elsewhere', 'table', 'join'),
        ('upkeep', 'stmt:007', 'ROOT', 0, 'somewhere', 'somewhere', 'table', 'from')
    ) v("task", "stmt", "scope", "ord", "alias", "source", "source_type", "position")""",
    "q_x10_expansions": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("column" AS VARCHAR) AS "column", CAST("display" AS VARCHAR) AS "display", CAST("expanded" AS VARCHAR) AS "expanded", CAST("status" AS VARCHAR) AS "status", CAST("reasons" AS VARCHAR) AS "reasons", CAST("substitutions" AS INTEGER) AS "substitutions" FROM (VALUES
        ('daily', 'stmt:002', 'ROOT', 'o_custkey', 'o_custkey', 'orders.o_custkey', 'resolved', '', 0),
        ('daily', 'stmt:002', 'ROOT', 'o_orderkey', 'o_orderkey', 'orders.o_orderkey', 'resolved', '', 0),
        ('daily', 'stmt:002', 'ROOT', 'o_totalprice', 'o_totalprice', 'orders.o_totalprice', 'resolved', '', 0),
        ('daily', 'stmt:003', 'ROOT', 'best', 'max(o_totalprice)', 'max(recent.o_totalprice)', 'resolved', '', 0),
        ('daily', 'stmt:003', 'ROOT', 'k', 'o_custkey', 'recent.o_custkey', 'resolved', '', 0),
        ('daily', 'stmt:003', 'ROOT', 'n', 'count(1)', 'count(1)', 'resolved', '', 0),
        ('daily', 'stmt:005', 'ROOT', 'c_custkey', 'customer.c_custkey', 'customer.c_custkey', 'resolved', '', 0),
        ('daily', 'stmt:005', 'ROOT', 'c_name', 'customer.c_name', 'customer.c_name', 'resolved', '', 0),
        ('daily', 'stmt:005', 'ROOT', 'n', 'coalesce(counted.n, 0)', 'coalesce(counted.n, 0)', 'resolved', '', 0),
        ('daily', 'stmt:006', 'ROOT', 'k', 'k', 'UNION(customer.c_custkey, supplier.s_suppkey)', 'resolved', '', 3),
        ('daily', 'stmt:006', 'union:main', 'k', 'k', 'UNION(customer.c_custkey, supplier.s_suppkey)', 'resolved', '', 2),
        ('daily', 'stmt:006', 'union:main:b00', 'k', 'c_custkey', 'customer.c_custkey', 'resolved', '', 0),
        ('daily', 'stmt:006', 'union:main:b01', 's_suppkey', 's_suppkey', 'supplier.s_suppkey', 'resolved', '', 0),
        ('daily', 'stmt:007', 'ROOT', 'l_partkey', 'l_partkey', 'lineitem.l_partkey', 'resolved', '', 0),
        ('revenue', 'stmt:001', 'ROOT', 'c_mktsegment', 'customer.c_mktsegment', 'customer.c_mktsegment', 'resolved', '', 0),
        ('revenue', 'stmt:001', 'ROOT', 'revenue', 'sum(cte:priced.net)', 'sum((lineitem.l_extendedprice * (1 - lineitem.l_discount)))', 'resolved', '', 1),
        ('revenue', 'stmt:001', 'cte:priced', 'l_orderkey', 'l_orderkey', 'lineitem.l_orderkey', 'resolved', '', 0),
        ('revenue', 'stmt:001', 'cte:priced', 'net', '(l_extendedprice * (1 - l_discount))', '(lineitem.l_extendedprice * (1 - lineitem.l_discount))', 'resolved', '', 0),
        ('upkeep', 'stmt:001', 'ROOT', 'amount', '(mart.balance.amount + subq:s.amount)', '(mart.balance.amount + customer.c_acctbal)', 'resolved', '', 1),
        ('upkeep', 'stmt:001', 'ROOT', 'id', 'subq:s.id', 'customer.c_custkey', 'resolved', '', 1),
        ('upkeep', 'stmt:001', 'subq:s', 'amount', 'c_acctbal', 'customer.c_acctbal', 'resolved', '', 0),
        ('upkeep', 'stmt:001', 'subq:s', 'id', 'c_custkey', 'customer.c_custkey', 'resolved', '', 0),
        ('upkeep', 'stmt:002', 'ROOT', 'amount', '0', '0', 'resolved', '', 0),
        ('upkeep', 'stmt:005', 'ROOT', 'event_type', 'event_type', 'events.event_type', 'resolved', '', 1),
        ('upkeep', 'stmt:005', 'ROOT', 'user_id', 'user_id', 'events.user_id', 'resolved', '', 1),
        ('upkeep', 'stmt:005', 'subq:q', 'event_type', 'event_type', 'events.event_type', 'resolved', '', 0),
        ('upkeep', 'stmt:005', 'subq:q', 'rn', 'row_number() OVER (PARTITION BY user_id ORDER BY ts DESC)', 'row_number() OVER (PARTITION BY events.user_id ORDER BY events.ts DESC)', 'resolved', '', 0),
        ('upkeep', 'stmt:005', 'subq:q', 'user_id', 'user_id', 'events.user_id', 'resolved', '', 0),
        ('upkeep', 'stmt:006', 'ROOT', 'label', 'somewhere.label', 'somewhere.label', 'resolved', '', 0),
        ('upkeep', 'stmt:006', 'ROOT', 'name', 'name', 'name', 'partially_resolved', 'ambiguous_unqualified', 0),
        ('upkeep', 'stmt:007', 'ROOT', '*', '*', '*', 'partially_resolved', 'star_not_expanded', 0)
    ) v("task", "stmt", "scope", "column", "display", "expanded", "status", "reasons", "substitutions")""",
    "q_x16_mapping_steps": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("column" AS VARCHAR) AS "column", CAST("target" AS VARCHAR) AS "target", CAST("step_no" AS INTEGER) AS "step_no", CAST("transform" AS VARCHAR) AS "transform", CAST("expression" AS VARCHAR) AS "expression" FROM (VALUES
        ('daily', 'stmt:002', 'ROOT', 'o_custkey', 'o_custkey', 1, 'DIRECT', 'o_custkey'),
        ('daily', 'stmt:002', 'ROOT', 'o_orderkey', 'o_orderkey', 1, 'DIRECT', 'o_orderkey'),
        ('daily', 'stmt:002', 'ROOT', 'o_totalprice', 'o_totalprice', 1, 'DIRECT', 'o_totalprice'),
        ('daily', 'stmt:003', 'ROOT', 'best', 'best', 1, 'AGGREGATE', 'max(o_totalprice)'),
        ('daily', 'stmt:003', 'ROOT', 'k', 'k', 1, 'DIRECT', 'o_custkey'),
        ('daily', 'stmt:003', 'ROOT', 'n', 'n', 1, 'AGGREGATE', 'count(1)'),
        ('daily', 'stmt:005', 'ROOT', 'c_custkey', 'c_custkey', 1, 'DIRECT', 'c.c_custkey'),
        ('daily', 'stmt:005', 'ROOT', 'c_name', 'c_name', 1, 'DIRECT', 'c.c_name'),
        ('daily', 'stmt:005', 'ROOT', 'n', 'n', 1, 'EXPRESSION', 'coalesce(t.n, 0)'),
        ('daily', 'stmt:006', 'ROOT', 'k', 'k', 4, 'DIRECT', 'k'),
        ('daily', 'stmt:006', 'union:main', 'k', 'k', 3, 'UNION', 'k'),
        ('daily', 'stmt:006', 'union:main:b00', 'k', 'k', 1, 'DIRECT', 'c_custkey'),
        ('daily', 'stmt:006', 'union:main:b01', 's_suppkey', 'k', 2, 'DIRECT', 's_suppkey'),
        ('daily', 'stmt:007', 'ROOT', 'l_partkey', 'l_partkey', 1, 'DIRECT', 'l_partkey'),
        ('revenue', 'stmt:001', 'ROOT', 'c_mktsegment', 'c_mktsegment', 1, 'DIRECT', 'c.c_mktsegment'),
        ('revenue', 'stmt:001', 'ROOT', 'revenue', 'revenue', 2, 'AGGREGATE', 'sum(p.net)'),
        ('revenue', 'stmt:001', 'cte:priced', 'net', 'revenue', 1, 'EXPRESSION', '(l_extendedprice * (1 - l_discount))'),
        ('upkeep', 'stmt:001', 'ROOT', 'amount', 'amount', 2, 'DIRECT', 's.amount'),
        ('upkeep', 'stmt:001', 'ROOT', 'amount', 'amount', 2, 'EXPRESSION', '(t.amount + s.amount)'),
        ('upkeep', 'stmt:001', 'ROOT', 'id', 'id', 2, 'DIRECT', 's.id'),
        ('upkeep', 'stmt:001', 'subq:s', 'amount', 'amount', 1, 'DIRECT', 'c_acctbal'),
        ('upkeep', 'stmt:001', 'subq:s', 'id', 'id', 1, 'DIRECT', 'c_custkey'),
        ('upkeep', 'stmt:002', 'ROOT', 'amount', 'amount', 1, 'CONSTANT', '0'),
        ('upkeep', 'stmt:005', 'ROOT', 'event_type', 'event_type', 2, 'DIRECT', 'event_type'),
        ('upkeep', 'stmt:005', 'ROOT', 'user_id', 'user_id', 2, 'DIRECT', 'user_id'),
        ('upkeep', 'stmt:005', 'subq:q', 'event_type', 'event_type', 1, 'DIRECT', 'event_type'),
        ('upkeep', 'stmt:005', 'subq:q', 'user_id', 'user_id', 1, 'DIRECT', 'user_id'),
        ('upkeep', 'stmt:006', 'ROOT', 'label', 'label', 1, 'DIRECT', 'x.label'),
        ('upkeep', 'stmt:006', 'ROOT', 'name', 'name', 1, 'DIRECT', 'name'),
        ('upkeep', 'stmt:007', 'ROOT', '*', '*', 1, 'EXPAND_ALL', '*')
    ) v("task", "stmt", "scope", "column", "target", "step_no", "transform", "expression")""",
    "q_x47_chains": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("target" AS VARCHAR) AS "target", CAST("chain" AS VARCHAR) AS "chain" FROM (VALUES
        ('daily', 'stmt:002', 'o_custkey', 'ROOT.o_custkey: o_custkey'),
        ('daily', 'stmt:002', 'o_orderkey', 'ROOT.o_orderkey: o_orderkey'),
        ('daily', 'stmt:002', 'o_totalprice', 'ROOT.o_totalprice: o_totalprice'),
        ('daily', 'stmt:003', 'best', 'ROOT.best: max(o_totalprice)'),
        ('daily', 'stmt:003', 'k', 'ROOT.k: o_custkey'),
        ('daily', 'stmt:003', 'n', 'ROOT.n: count(1)'),
        ('daily', 'stmt:005', 'c_custkey', 'ROOT.c_custkey: c.c_custkey'),
        ('daily', 'stmt:005', 'c_name', 'ROOT.c_name: c.c_name'),
        ('daily', 'stmt:005', 'n', 'ROOT.n: coalesce(t.n, 0)'),
        ('daily', 'stmt:006', 'k', 'union:main:b00.k: c_custkey -> union:main:b01.s_suppkey: s_suppkey -> union:main.k: k -> ROOT.k: k'),
        ('daily', 'stmt:007', 'l_partkey', 'ROOT.l_partkey: l_partkey'),
        ('revenue', 'stmt:001', 'c_mktsegment', 'ROOT.c_mktsegment: c.c_mktsegment'),
        ('revenue', 'stmt:001', 'revenue', 'cte:priced.net: (l_extendedprice * (1 - l_discount)) -> ROOT.revenue: sum(p.net)'),
        ('upkeep', 'stmt:001', 'amount', 'subq:s.amount: c_acctbal -> ROOT.amount: (t.amount + s.amount) -> ROOT.amount: s.amount'),
        ('upkeep', 'stmt:001', 'id', 'subq:s.id: c_custkey -> ROOT.id: s.id'),
        ('upkeep', 'stmt:002', 'amount', 'ROOT.amount: 0'),
        ('upkeep', 'stmt:005', 'event_type', 'subq:q.event_type: event_type -> ROOT.event_type: event_type'),
        ('upkeep', 'stmt:005', 'user_id', 'subq:q.user_id: user_id -> ROOT.user_id: user_id'),
        ('upkeep', 'stmt:006', 'label', 'ROOT.label: x.label'),
        ('upkeep', 'stmt:006', 'name', 'ROOT.name: name'),
        ('upkeep', 'stmt:007', '*', 'ROOT.*: *')
    ) v("task", "stmt", "target", "chain")""",
    "q_x19_usage": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("source" AS VARCHAR) AS "source", CAST("field" AS VARCHAR) AS "field", CAST("used_by" AS VARCHAR) AS "used_by" FROM (VALUES
        ('daily', 'stmt:002', 'orders', 'o_custkey', 'output'),
        ('daily', 'stmt:002', 'orders', 'o_orderdate', 'filter'),
        ('daily', 'stmt:002', 'orders', 'o_orderkey', 'output'),
        ('daily', 'stmt:002', 'orders', 'o_totalprice', 'output'),
        ('daily', 'stmt:003', 'recent', '*', 'output'),
        ('daily', 'stmt:003', 'recent', 'o_custkey', 'group_by,output'),
        ('daily', 'stmt:003', 'recent', 'o_totalprice', 'output'),
        ('daily', 'stmt:005', 'counted', 'k', 'join'),
        ('daily', 'stmt:005', 'counted', 'n', 'output'),
        ('daily', 'stmt:005', 'customer', 'c_custkey', 'join,output'),
        ('daily', 'stmt:005', 'customer', 'c_name', 'output'),
        ('daily', 'stmt:006', 'customer', 'c_custkey', 'output'),
        ('daily', 'stmt:006', 'supplier', 's_suppkey', 'output'),
        ('daily', 'stmt:006', 'union:main', 'k', 'output'),
        ('daily', 'stmt:006', 'union:main:b00', 'k', 'output'),
        ('daily', 'stmt:006', 'union:main:b01', 's_suppkey', 'output'),
        ('daily', 'stmt:007', 'lineitem', 'l_partkey', 'output'),
        ('revenue', 'stmt:001', 'cte:priced', 'l_orderkey', 'join'),
        ('revenue', 'stmt:001', 'cte:priced', 'net', 'output'),
        ('revenue', 'stmt:001', 'customer', 'c_custkey', 'join'),
        ('revenue', 'stmt:001', 'customer', 'c_mktsegment', 'group_by,output'),
        ('revenue', 'stmt:001', 'lineitem', 'l_discount', 'output'),
        ('revenue', 'stmt:001', 'lineitem', 'l_extendedprice', 'output'),
        ('revenue', 'stmt:001', 'lineitem', 'l_orderkey', 'output'),
        ('revenue', 'stmt:001', 'lineitem', 'l_shipdate', 'filter'),
        ('revenue', 'stmt:001', 'orders', 'o_custkey', 'join'),
        ('revenue', 'stmt:001', 'orders', 'o_orderkey', 'join'),
        ('upkeep', 'stmt:001', 'customer', 'c_acctbal', 'output'),
        ('upkeep', 'stmt:001', 'customer', 'c_custkey', 'output'),
        ('upkeep', 'stmt:001', 'mart.balance', 'amount', 'output'),
        ('upkeep', 'stmt:001', 'mart.balance', 'id', 'filter'),
        ('upkeep', 'stmt:001', 'subq:s', 'amount', 'filter,output'),
        ('upkeep', 'stmt:001', 'subq:s', 'id', 'filter,output'),
        ('upkeep', 'stmt:002', 'mart.balance', 'amount', 'filter'),
        ('upkeep', 'stmt:003', 'mart.balance', 'id', 'filter'),
        ('upkeep', 'stmt:005', 'events', '*', 'output'),
        ('upkeep', 'stmt:005', 'events', 'event_type', 'output'),
        ('upkeep', 'stmt:005', 'events', 'ts', 'window'),
        ('upkeep', 'stmt:005', 'events', 'user_id', 'output,window'),
        ('upkeep', 'stmt:005', 'subq:q', 'event_type', 'output'),
        ('upkeep', 'stmt:005', 'subq:q', 'rn', 'filter'),
        ('upkeep', 'stmt:005', 'subq:q', 'user_id', 'output'),
        ('upkeep', 'stmt:006', 'elsewhere', 'id', 'join'),
        ('upkeep', 'stmt:006', 'elsewhere', 'name', 'output'),
        ('upkeep', 'stmt:006', 'somewhere', 'id', 'join'),
        ('upkeep', 'stmt:006', 'somewhere', 'label', 'output'),
        ('upkeep', 'stmt:006', 'somewhere', 'name', 'output'),
        ('upkeep', 'stmt:007', 'somewhere', '*', 'output')
    ) v("task", "stmt", "source", "field", "used_by")""",
    "q_x20_logic_blocks": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("block" AS VARCHAR) AS "block", CAST("type" AS VARCHAR) AS "type", CAST("expression" AS VARCHAR) AS "expression", CAST("fingerprint" AS VARCHAR) AS "fingerprint", CAST("status" AS VARCHAR) AS "status" FROM (VALUES
        ('daily', 'stmt:002', 'ROOT', 'logic:ROOT:filter:001', 'filter', '(o_orderdate >= ''1997-01-01 00:00:00'')', 'filter:(o_orderdate >= ''1997-01-01 00:00:00'')', 'complete'),
        ('daily', 'stmt:003', 'ROOT', 'logic:ROOT:aggregate:001', 'aggregate', 'count(1)', 'aggregate:count(1)', 'complete'),
        ('daily', 'stmt:003', 'ROOT', 'logic:ROOT:aggregate:002', 'aggregate', 'max(o_totalprice)', 'aggregate:max(o_totalprice)', 'complete'),
        ('daily', 'stmt:003', 'ROOT', 'logic:ROOT:group_by:001', 'group_by', 'o_custkey', 'group_by:o_custkey', 'complete'),
        ('daily', 'stmt:005', 'ROOT', 'logic:ROOT:join:001', 'join', 'LEFT_OUTER c t (c.c_custkey = t.k)', 'join:left_outer c t (c.c_custkey = t.k)', 'complete'),
        ('daily', 'stmt:006', 'union:main', 'logic:union:main:union:001', 'union', 'k', 'union:k', 'complete'),
        ('revenue', 'stmt:001', 'ROOT', 'logic:ROOT:aggregate:001', 'aggregate', 'sum(p.net)', 'aggregate:sum(p.net)', 'complete'),
        ('revenue', 'stmt:001', 'ROOT', 'logic:ROOT:group_by:001', 'group_by', 'c.c_mktsegment', 'group_by:c.c_mktsegment', 'complete'),
        ('revenue', 'stmt:001', 'ROOT', 'logic:ROOT:join:001', 'join', 'INNER p o (p.l_orderkey = o.o_orderkey)', 'join:inner p o (p.l_orderkey = o.o_orderkey)', 'complete'),
        ('revenue', 'stmt:001', 'ROOT', 'logic:ROOT:join:002', 'join', 'INNER p,o c (o.o_custkey = c.c_custkey)', 'join:inner p,o c (o.o_custkey = c.c_custkey)', 'complete'),
        ('revenue', 'stmt:001', 'cte:priced', 'logic:cte:priced:filter:001', 'filter', '(l_shipdate >= ''1998-01-01 00:00:00'')', 'filter:(l_shipdate >= ''1998-01-01 00:00:00'')', 'complete'),
        ('upkeep', 'stmt:001', 'ROOT', 'logic:ROOT:filter:001', 'filter', '(t.id = s.id)', 'filter:(t.id = s.id)', 'complete'),
        ('upkeep', 'stmt:001', 'ROOT', 'logic:ROOT:filter:002', 'filter', '(s.amount < 0)', 'filter:(s.amount < 0)', 'complete'),
        ('upkeep', 'stmt:002', 'ROOT', 'logic:ROOT:filter:001', 'filter', '(amount < 0.5)', 'filter:(amount < 0.5)', 'complete'),
        ('upkeep', 'stmt:003', 'ROOT', 'logic:ROOT:filter:001', 'filter', '(id IS NULL)', 'filter:(id is null)', 'complete'),
        ('upkeep', 'stmt:005', 'ROOT', 'logic:ROOT:filter:001', 'filter', '(rn = 1)', 'filter:(rn = 1)', 'complete'),
        ('upkeep', 'stmt:005', 'subq:q', 'logic:subq:q:window:001', 'window', 'row_number() OVER (PARTITION BY user_id ORDER BY ts DESC)', 'window:row_number() over (partition by user_id order by ts desc)', 'complete'),
        ('upkeep', 'stmt:006', 'ROOT', 'logic:ROOT:join:001', 'join', 'INNER x y (x.id = y.id)', 'join:inner x y (x.id = y.id)', 'complete')
    ) v("task", "stmt", "scope", "block", "type", "expression", "fingerprint", "status")""",
    "q_x22_coverage": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("relation" AS VARCHAR) AS "relation", CAST("covered_by" AS VARCHAR) AS "covered_by" FROM (VALUES
        ('daily', 'counted', 'script'),
        ('daily', 'customer', 'metadata'),
        ('daily', 'lineitem', 'metadata'),
        ('daily', 'mart.all_keys', NULL),
        ('daily', 'mart.customer_daily', 'metadata'),
        ('daily', 'orders', 'metadata'),
        ('daily', 'recent', 'script'),
        ('daily', 'supplier', 'metadata'),
        ('revenue', 'customer', 'metadata'),
        ('revenue', 'lineitem', 'metadata'),
        ('revenue', 'mart.revenue_by_segment', 'metadata'),
        ('revenue', 'orders', 'metadata'),
        ('upkeep', 'customer', 'metadata'),
        ('upkeep', 'elsewhere', NULL),
        ('upkeep', 'events', 'metadata'),
        ('upkeep', 'mart.balance', NULL),
        ('upkeep', 'mart.guess', NULL),
        ('upkeep', 'mart.latest', 'script'),
        ('upkeep', 'mart.staging', NULL),
        ('upkeep', 'mart.wide', NULL),
        ('upkeep', 'somewhere', NULL)
    ) v("task", "relation", "covered_by")""",
    "q_x25_binding": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("target" AS VARCHAR) AS "target", CAST("ordinal" AS INTEGER) AS "ordinal", CAST("parsed_name" AS VARCHAR) AS "parsed_name", CAST("target_column" AS VARCHAR) AS "target_column", CAST("status" AS VARCHAR) AS "status" FROM (VALUES
        ('daily', 'stmt:005', 'mart.customer_daily', 0, 'c_custkey', 'custkey', 'applied'),
        ('daily', 'stmt:005', 'mart.customer_daily', 1, 'c_name', 'name', 'applied'),
        ('daily', 'stmt:005', 'mart.customer_daily', 2, 'n', 'orders', 'applied'),
        ('daily', 'stmt:006', 'mart.all_keys', 0, 'k', 'k', 'metadata_not_provided'),
        ('daily', 'stmt:007', 'mart.all_keys', 0, 'l_partkey', 'l_partkey', 'metadata_not_provided'),
        ('revenue', 'stmt:001', 'mart.revenue_by_segment', 0, 'c_mktsegment', 'segment', 'applied'),
        ('revenue', 'stmt:001', 'mart.revenue_by_segment', 1, 'revenue', 'revenue', 'applied'),
        ('upkeep', 'stmt:006', 'mart.guess', 0, 'name', 'name', 'metadata_not_provided'),
        ('upkeep', 'stmt:006', 'mart.guess', 1, 'label', 'label', 'metadata_not_provided'),
        ('upkeep', 'stmt:007', 'mart.wide', 0, '*', '*', 'metadata_not_provided')
    ) v("task", "stmt", "target", "ordinal", "parsed_name", "target_column", "status")""",
    "q_x27_gaps": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("gap" AS VARCHAR) AS "gap", CAST("type" AS VARCHAR) AS "type", CAST("bucket" AS VARCHAR) AS "bucket", CAST("column" AS VARCHAR) AS "column", CAST("reason" AS VARCHAR) AS "reason", CAST("root_impact" AS BOOLEAN) AS "root_impact" FROM (VALUES
        ('upkeep', 'stmt:006', 'lineage_gap:0001', 'expression_source_unresolved', 'bare_unqualified_field', 'name', 'ambiguous_unqualified', TRUE),
        ('upkeep', 'stmt:007', 'lineage_gap:0002', 'projection_wildcard_unexpanded', 'wildcard_projection', '*', 'star_not_expanded', TRUE)
    ) v("task", "stmt", "gap", "type", "bucket", "column", "reason", "root_impact")""",
    "q_x30_warnings": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("type" AS VARCHAR) AS "type", CAST("detail" AS VARCHAR) AS "detail" FROM (VALUES
        ('upkeep', 'stmt:001', 'ROOT', 'merge_delete_ignored', 'matched:0'),
        ('upkeep', 'stmt:006', 'ROOT', 'ambiguous_unqualified', 'name'),
        ('upkeep', 'stmt:007', 'ROOT', 'star_not_expanded', 'somewhere'),
        ('upkeep', 'stmt:008', 'ROOT', 'unsupported_statement', 'DropTable')
    ) v("task", "stmt", "scope", "type", "detail")""",
    "q_x32_statistics": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("kind" AS VARCHAR) AS "kind", CAST("target" AS VARCHAR) AS "target", CAST("n_scopes" AS BIGINT) AS "n_scopes", CAST("n_tables" AS BIGINT) AS "n_tables", CAST("n_columns" AS BIGINT) AS "n_columns", CAST("n_joins" AS BIGINT) AS "n_joins", CAST("n_predicates" AS BIGINT) AS "n_predicates", CAST("n_aggregates" AS BIGINT) AS "n_aggregates", CAST("n_windows" AS BIGINT) AS "n_windows", CAST("n_cases" AS BIGINT) AS "n_cases", CAST("n_warnings" AS BIGINT) AS "n_warnings", CAST("depth" AS INTEGER) AS "depth" FROM (VALUES
        ('daily', 'stmt:001', 'OTHER', '', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
        ('daily', 'stmt:002', 'CTAS', 'recent', 1, 1, 3, 0, 1, 0, 0, 0, 0, 1),
        ('daily', 'stmt:003', 'CTAS', 'counted', 1, 1, 3, 0, 0, 2, 0, 0, 0, 1),
        ('daily', 'stmt:004', 'EMPTY', '', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
        ('daily', 'stmt:005', 'INSERT_OVERWRITE', 'mart.customer_daily', 1, 2, 3, 1, 0, 0, 0, 0, 0, 1),
        ('daily', 'stmt:006', 'INSERT', 'mart.all_keys', 4, 2, 4, 0, 0, 0, 0, 0, 0, 3),
        ('daily', 'stmt:007', 'INSERT', 'mart.all_keys', 1, 1, 1, 0, 0, 0, 0, 0, 0, 1),
        ('daily', 'stmt:008', 'COMMENT', '', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
        ('revenue', 'stmt:001', 'INSERT_OVERWRITE', 'mart.revenue_by_segment', 2, 3, 4, 2, 1, 1, 0, 0, 0, 2),
        ('upkeep', 'stmt:001', 'MERGE', 'mart.balance', 2, 2, 5, 0, 2, 0, 0, 0, 1, 2),
        ('upkeep', 'stmt:002', 'UPDATE', 'mart.balance', 1, 1, 1, 0, 1, 0, 0, 0, 0, 1),
        ('upkeep', 'stmt:003', 'DELETE', 'mart.balance', 1, 1, 0, 0, 1, 0, 0, 0, 0, 1),
        ('upkeep', 'stmt:004', 'TRUNCATE', 'mart.staging', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
        ('upkeep', 'stmt:005', 'CTAS', 'mart.latest', 2, 1, 5, 0, 1, 0, 1, 0, 0, 2),
        ('upkeep', 'stmt:006', 'INSERT', 'mart.guess', 1, 2, 2, 1, 0, 0, 0, 0, 1, 1),
        ('upkeep', 'stmt:007', 'INSERT', 'mart.wide', 1, 1, 1, 0, 0, 0, 0, 0, 1, 1),
        ('upkeep', 'stmt:008', 'OTHER', '', 0, 0, 0, 0, 0, 0, 0, 0, 1, 0),
        ('upkeep', 'stmt:009', 'FAILED', '', 0, 0, 0, 0, 0, 0, 0, 0, 1, 0)
    ) v("task", "stmt", "kind", "target", "n_scopes", "n_tables", "n_columns", "n_joins", "n_predicates", "n_aggregates", "n_windows", "n_cases", "n_warnings", "depth")""",
    "q_x33_profile": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("level" AS INTEGER) AS "level", CAST("kind" AS VARCHAR) AS "kind", CAST("role" AS VARCHAR) AS "role", CAST("n_columns" AS BIGINT) AS "n_columns" FROM (VALUES
        ('daily', 'stmt:002', 'ROOT', 0, 'root', 'filter', 3),
        ('daily', 'stmt:003', 'ROOT', 0, 'root', 'aggregate', 3),
        ('daily', 'stmt:005', 'ROOT', 0, 'root', 'join', 3),
        ('daily', 'stmt:006', 'ROOT', 2, 'root', 'pass_through', 1),
        ('daily', 'stmt:006', 'union:main', 1, 'union', 'union', 1),
        ('daily', 'stmt:006', 'union:main:b00', 0, 'union_branch', 'union_branch', 1),
        ('daily', 'stmt:006', 'union:main:b01', 0, 'union_branch', 'union_branch', 1),
        ('daily', 'stmt:007', 'ROOT', 0, 'root', 'pass_through', 1),
        ('revenue', 'stmt:001', 'ROOT', 1, 'root', 'aggregate', 2),
        ('revenue', 'stmt:001', 'cte:priced', 0, 'cte', 'filter', 2),
        ('upkeep', 'stmt:001', 'ROOT', 1, 'root', 'transform', 3),
        ('upkeep', 'stmt:001', 'subq:s', 0, 'subquery', 'pass_through', 2),
        ('upkeep', 'stmt:002', 'ROOT', 0, 'root', 'filter', 1),
        ('upkeep', 'stmt:003', 'ROOT', 0, 'root', 'filter', 0),
        ('upkeep', 'stmt:005', 'ROOT', 1, 'root', 'filter', 2),
        ('upkeep', 'stmt:005', 'subq:q', 0, 'subquery', 'dedup', 3),
        ('upkeep', 'stmt:006', 'ROOT', 0, 'root', 'join', 2),
        ('upkeep', 'stmt:007', 'ROOT', 0, 'root', 'pass_through', 1)
    ) v("task", "stmt", "scope", "level", "kind", "role", "n_columns")""",
    "q_x38_conditions": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("state" AS VARCHAR) AS "state", CAST("kind" AS VARCHAR) AS "kind", CAST("source" AS VARCHAR) AS "source", CAST("source_column" AS VARCHAR) AS "source_column" FROM (VALUES
        ('daily', 'state:recent:001', 'where', 'orders', 'o_orderdate'),
        ('revenue', 'state:mart.revenue_by_segment:001', 'where', 'lineitem', 'l_shipdate'),
        ('upkeep', 'state:mart.balance:001', 'merge_matched', 'customer', 'c_acctbal'),
        ('upkeep', 'state:mart.balance:001', 'merge_on', 'customer', 'c_custkey'),
        ('upkeep', 'state:mart.balance:001', 'merge_on', 'mart.balance', 'id'),
        ('upkeep', 'state:mart.balance:002', 'where', 'mart.balance', 'amount'),
        ('upkeep', 'state:mart.balance:003', 'where', 'mart.balance', 'id')
    ) v("task", "state", "kind", "source", "source_column")""",
    "q_x40_fold": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("state" AS VARCHAR) AS "state", CAST("column" AS VARCHAR) AS "column", CAST("source" AS VARCHAR) AS "source", CAST("source_column" AS VARCHAR) AS "source_column", CAST("source_state" AS VARCHAR) AS "source_state", CAST("transform" AS VARCHAR) AS "transform", CAST("reason" AS VARCHAR) AS "reason" FROM (VALUES
        ('daily', 'state:mart.all_keys:001', 'k', 'customer', 'c_custkey', NULL, 'UNION', NULL),
        ('daily', 'state:mart.all_keys:001', 'k', 'supplier', 's_suppkey', NULL, 'UNION', NULL),
        ('daily', 'state:mart.all_keys:002', 'k', 'mart.all_keys', 'k', 'state:mart.all_keys:001', 'DIRECT', NULL),
        ('daily', 'state:mart.all_keys:002', 'l_partkey', 'lineitem', 'l_partkey', NULL, 'DIRECT', NULL),
        ('daily', 'state:mart.all_keys:002', 'l_partkey', 'mart.all_keys', 'l_partkey', 'state:mart.all_keys:001', 'DIRECT', NULL),
        ('daily', 'state:mart.customer_daily:001', 'c_custkey', 'customer', 'c_custkey', NULL, 'DIRECT', NULL),
        ('daily', 'state:mart.customer_daily:001', 'c_name', 'customer', 'c_name', NULL, 'DIRECT', NULL),
        ('daily', 'state:mart.customer_daily:001', 'n', 'orders', '*', NULL, 'AGGREGATE', NULL),
        ('revenue', 'state:mart.revenue_by_segment:001', 'c_mktsegment', 'customer', 'c_mktsegment', NULL, 'DIRECT', NULL),
        ('revenue', 'state:mart.revenue_by_segment:001', 'revenue', 'lineitem', 'l_discount', NULL, 'AGGREGATE', NULL),
        ('revenue', 'state:mart.revenue_by_segment:001', 'revenue', 'lineitem', 'l_extendedprice', NULL, 'AGGREGATE', NULL),
        ('upkeep', 'state:mart.balance:001', 'amount', 'customer', 'c_acctbal', NULL, 'EXPRESSION', NULL),
        ('upkeep', 'state:mart.balance:001', 'amount', 'mart.balance', 'amount', NULL, 'EXPRESSION', NULL),
        ('upkeep', 'state:mart.balance:001', 'id', 'customer', 'c_custkey', NULL, 'DIRECT', NULL),
        ('upkeep', 'state:mart.balance:002', 'amount', 'mart.balance', 'amount', 'state:mart.balance:001', 'DIRECT', NULL),
        ('upkeep', 'state:mart.balance:002', 'id', 'mart.balance', 'id', 'state:mart.balance:001', 'DIRECT', NULL),
        ('upkeep', 'state:mart.balance:003', 'amount', 'mart.balance', 'amount', 'state:mart.balance:002', 'DIRECT', NULL),
        ('upkeep', 'state:mart.balance:003', 'id', 'mart.balance', 'id', 'state:mart.balance:002', 'DIRECT', NULL),
        ('upkeep', 'state:mart.guess:001', 'label', 'somewhere', 'label', NULL, 'DIRECT', NULL),
        ('upkeep', 'state:mart.latest:001', 'event_type', 'events', 'event_type', NULL, 'DIRECT', NULL),
        ('upkeep', 'state:mart.latest:001', 'user_id', 'events', 'user_id', NULL, 'DIRECT', NULL)
    ) v("task", "state", "column", "source", "source_column", "source_state", "transform", "reason")""",
    "q_x42_cross_references": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("problem" AS VARCHAR) AS "problem", CAST("name" AS VARCHAR) AS "name" FROM (VALUES
        (NULL, NULL, NULL, NULL)
    ) v("task", "stmt", "problem", "name") WHERE false""",
    "q_x45_quality_gate": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("failures" AS VARCHAR) AS "failures", CAST("passed" AS BOOLEAN) AS "passed" FROM (VALUES
        ('daily', '', TRUE),
        ('revenue', '', TRUE),
        ('upkeep', 'root_gap,statement_not_modeled', FALSE)
    ) v("task", "failures", "passed")""",
    "q_j6_join_keys": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("ord" AS INTEGER) AS "ord", CAST("left_alias" AS VARCHAR) AS "left_alias", CAST("left_column" AS VARCHAR) AS "left_column", CAST("right_alias" AS VARCHAR) AS "right_alias", CAST("right_column" AS VARCHAR) AS "right_column" FROM (VALUES
        ('daily', 'stmt:005', 'ROOT', 0, 'c', 'c_custkey', 't', 'k'),
        ('revenue', 'stmt:001', 'ROOT', 0, 'p', 'l_orderkey', 'o', 'o_orderkey'),
        ('revenue', 'stmt:001', 'ROOT', 1, 'o', 'o_custkey', 'c', 'c_custkey'),
        ('upkeep', 'stmt:006', 'ROOT', 0, 'x', 'id', 'y', 'id')
    ) v("task", "stmt", "scope", "ord", "left_alias", "left_column", "right_alias", "right_column")""",
    "q_j9_relations": r"""SELECT CAST("left_table" AS VARCHAR) AS "left_table", CAST("join_type" AS VARCHAR) AS "join_type", CAST("right_table" AS VARCHAR) AS "right_table", CAST("keys" AS VARCHAR) AS "keys", CAST("n" AS BIGINT) AS "n" FROM (VALUES
        ('lineitem', 'INNER', 'orders', 'l_orderkey=o_orderkey', 1),
        ('customer', 'LEFT_OUTER', 'counted', 'c_custkey=k', 1),
        ('orders', 'INNER', 'customer', 'o_custkey=c_custkey', 1),
        ('somewhere', 'INNER', 'elsewhere', 'id=id', 1)
    ) v("left_table", "join_type", "right_table", "keys", "n")""",
    "q_p9_projection_facts": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("ord" AS INTEGER) AS "ord", CAST("column" AS VARCHAR) AS "column", CAST("transform" AS VARCHAR) AS "transform", CAST("expression" AS VARCHAR) AS "expression", CAST("expanded_type" AS VARCHAR) AS "expanded_type", CAST("role" AS VARCHAR) AS "role", CAST("grain_effect" AS VARCHAR) AS "grain_effect" FROM (VALUES
        ('daily', 'stmt:002', 'ROOT', 0, 'o_custkey', 'DIRECT', 'o_custkey', 'direct_projection', 'direct_projection', 'preserved'),
        ('daily', 'stmt:002', 'ROOT', 1, 'o_orderkey', 'DIRECT', 'o_orderkey', 'direct_projection', 'direct_projection', 'preserved'),
        ('daily', 'stmt:002', 'ROOT', 2, 'o_totalprice', 'DIRECT', 'o_totalprice', 'direct_projection', 'direct_projection', 'preserved'),
        ('daily', 'stmt:003', 'ROOT', 0, 'k', 'DIRECT', 'o_custkey', 'direct_projection', 'direct_projection', 'preserved'),
        ('daily', 'stmt:003', 'ROOT', 1, 'n', 'AGGREGATE', 'count(1)', 'aggregate_expression', 'metric_calculation', 'changed'),
        ('daily', 'stmt:003', 'ROOT', 2, 'best', 'AGGREGATE', 'max(o_totalprice)', 'aggregate_expression', 'metric_calculation', 'changed'),
        ('daily', 'stmt:005', 'ROOT', 0, 'c_custkey', 'DIRECT', 'c.c_custkey', 'direct_projection', 'direct_projection', 'preserved'),
        ('daily', 'stmt:005', 'ROOT', 1, 'c_name', 'DIRECT', 'c.c_name', 'direct_projection', 'direct_projection', 'preserved'),
        ('daily', 'stmt:005', 'ROOT', 2, 'n', 'EXPRESSION', 'coalesce(t.n, 0)', 'function_expression', 'cleaning', 'preserved'),
        ('daily', 'stmt:006', 'ROOT', 0, 'k', 'DIRECT', 'k', 'direct_projection', 'direct_projection', 'preserved'),
        ('daily', 'stmt:006', 'union:main', 0, 'k', 'UNION', 'k', 'unknown_expression', 'unknown', 'unknown'),
        ('daily', 'stmt:006', 'union:main:b00', 0, 'k', 'DIRECT', 'c_custkey', 'direct_projection', 'direct_projection', 'preserved'),
        ('daily', 'stmt:006', 'union:main:b01', 0, 's_suppkey', 'DIRECT', 's_suppkey', 'direct_projection', 'direct_projection', 'preserved'),
        ('daily', 'stmt:007', 'ROOT', 0, 'l_partkey', 'DIRECT', 'l_partkey', 'direct_projection', 'direct_projection', 'preserved'),
        ('revenue', 'stmt:001', 'ROOT', 0, 'c_mktsegment', 'DIRECT', 'c.c_mktsegment', 'direct_projection', 'direct_projection', 'preserved'),
        ('revenue', 'stmt:001', 'ROOT', 1, 'revenue', 'AGGREGATE', 'sum(p.net)', 'aggregate_expression', 'metric_calculation', 'changed'),
        ('revenue', 'stmt:001', 'cte:priced', 0, 'l_orderkey', 'DIRECT', 'l_orderkey', 'direct_projection', 'direct_projection', 'preserved'),
        ('revenue', 'stmt:001', 'cte:priced', 1, 'net', 'EXPRESSION', '(l_extendedprice * (1 - l_discount))', 'arithmetic_expression', 'field_derivation', 'preserved'),
        ('upkeep', 'stmt:001', 'ROOT', 0, 'amount', 'EXPRESSION', '(t.amount + s.amount)', 'arithmetic_expression', 'field_derivation', 'preserved'),
        ('upkeep', 'stmt:001', 'ROOT', 1, 'amount', 'DIRECT', 's.amount', 'direct_projection', 'direct_projection', 'preserved'),
        ('upkeep', 'stmt:001', 'ROOT', 2, 'id', 'DIRECT', 's.id', 'direct_projection', 'direct_projection', 'preserved'),
        ('upkeep', 'stmt:001', 'subq:s', 0, 'id', 'DIRECT', 'c_custkey', 'direct_projection', 'direct_projection', 'preserved'),
        ('upkeep', 'stmt:001', 'subq:s', 1, 'amount', 'DIRECT', 'c_acctbal', 'direct_projection', 'direct_projection', 'preserved'),
        ('upkeep', 'stmt:002', 'ROOT', 0, 'amount', 'CONSTANT', '0', 'constant_expression', 'constant_fill', 'preserved'),
        ('upkeep', 'stmt:005', 'ROOT', 0, 'user_id', 'DIRECT', 'user_id', 'direct_projection', 'direct_projection', 'preserved'),
        ('upkeep', 'stmt:005', 'ROOT', 1, 'event_type', 'DIRECT', 'event_type', 'direct_projection', 'direct_projection', 'preserved'),
        ('upkeep', 'stmt:005', 'subq:q', 0, 'user_id', 'DIRECT', 'user_id', 'direct_projection', 'direct_projection', 'preserved'),
        ('upkeep', 'stmt:005', 'subq:q', 1, 'event_type', 'DIRECT', 'event_type', 'direct_projection', 'direct_projection', 'preserved'),
        ('upkeep', 'stmt:005', 'subq:q', 2, 'rn', 'WINDOW', 'row_number() OVER (PARTITION BY user_id ORDER BY ts DESC)', 'window_expression', 'record_selection', 'preserved'),
        ('upkeep', 'stmt:006', 'ROOT', 0, 'name', 'DIRECT', 'name', 'direct_projection', 'direct_projection', 'preserved'),
        ('upkeep', 'stmt:006', 'ROOT', 1, 'label', 'DIRECT', 'x.label', 'direct_projection', 'direct_projection', 'preserved'),
        ('upkeep', 'stmt:007', 'ROOT', 0, '*', 'EXPAND_ALL', '*', 'arithmetic_expression', 'field_derivation', 'preserved')
    ) v("task", "stmt", "scope", "ord", "column", "transform", "expression", "expanded_type", "role", "grain_effect")""",
    "q_p18_predicates": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("ord" AS INTEGER) AS "ord", CAST("kind" AS VARCHAR) AS "kind", CAST("expression" AS VARCHAR) AS "expression", CAST("subtype" AS VARCHAR) AS "subtype", CAST("partition_filter" AS BOOLEAN) AS "partition_filter" FROM (VALUES
        ('daily', 'stmt:002', 'ROOT', 0, 'where', '(o_orderdate >= ''1997-01-01 00:00:00'')', NULL, FALSE),
        ('revenue', 'stmt:001', 'cte:priced', 0, 'where', '(l_shipdate >= ''1998-01-01 00:00:00'')', NULL, FALSE),
        ('upkeep', 'stmt:001', 'ROOT', 0, 'merge_on', '(t.id = s.id)', NULL, FALSE),
        ('upkeep', 'stmt:001', 'ROOT', 1, 'merge_matched', '(s.amount < 0)', NULL, FALSE),
        ('upkeep', 'stmt:002', 'ROOT', 0, 'where', '(amount < 0.5)', NULL, FALSE),
        ('upkeep', 'stmt:003', 'ROOT', 0, 'where', '(id IS NULL)', NULL, FALSE),
        ('upkeep', 'stmt:005', 'ROOT', 0, 'where', '(rn = 1)', NULL, FALSE)
    ) v("task", "stmt", "scope", "ord", "kind", "expression", "subtype", "partition_filter")""",
    "q_a1_groupings": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("ord" AS INTEGER) AS "ord", CAST("expression" AS VARCHAR) AS "expression", CAST("src_scope" AS VARCHAR) AS "src_scope", CAST("src_column" AS VARCHAR) AS "src_column" FROM (VALUES
        ('daily', 'stmt:003', 'ROOT', 0, 'o_custkey', 'recent', 'o_custkey'),
        ('revenue', 'stmt:001', 'ROOT', 0, 'c.c_mktsegment', 'customer', 'c_mktsegment')
    ) v("task", "stmt", "scope", "ord", "expression", "src_scope", "src_column")""",
    "q_w4_window_context": r"""SELECT CAST("task" AS VARCHAR) AS "task", CAST("stmt" AS VARCHAR) AS "stmt", CAST("scope" AS VARCHAR) AS "scope", CAST("column" AS VARCHAR) AS "column", CAST("src_scope" AS VARCHAR) AS "src_scope", CAST("src_column" AS VARCHAR) AS "src_column", CAST("role" AS VARCHAR) AS "role" FROM (VALUES
        ('upkeep', 'stmt:005', 'subq:q', 'rn', 'events', 'ts', 'order'),
        ('upkeep', 'stmt:005', 'subq:q', 'rn', 'events', 'user_id', 'partition')
    ) v("task", "stmt", "scope", "column", "src_scope", "src_column", "role")""",
}

#: Base edges of the table graph: what each script's writes read.
TABLE_EDGES = """('counted', 'mart.customer_daily'), ('customer', 'mart.all_keys'), ('customer', 'mart.balance'), ('customer', 'mart.customer_daily'), ('customer', 'mart.revenue_by_segment'), ('elsewhere', 'mart.guess'), ('events', 'mart.latest'), ('lineitem', 'mart.all_keys'), ('lineitem', 'mart.revenue_by_segment'), ('mart.balance', 'mart.balance'), ('orders', 'mart.revenue_by_segment'), ('orders', 'recent'), ('recent', 'counted'), ('somewhere', 'mart.guess'), ('somewhere', 'mart.wide'), ('supplier', 'mart.all_keys')"""
