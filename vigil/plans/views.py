"""Inputs of the registered queries, built from the given tables by expressions that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TEST_PEPPER = bytes(range(32))

#: name -> (table, SQL); {0} stands for the table.
VIEWS = {
    # A scan sees a credential of a user's config; the secret changes with k.
    "obs": ("events", """SELECT event_id, concat('env:/srv/u', user_id, '/app.env#', upper(event_type), '_TOKEN') AS location,
        concat('key-', regexp_extract(props, '"k": ([0-9]+)', 1), '-', event_type, '-value') AS secret, ts FROM {0}"""),
    "env_lines": ("customer", """SELECT concat('/srv/n', c_nationkey, '/app.env') AS path, c_custkey AS line, CASE c_custkey % 10
        WHEN 0 THEN concat('export DB_PASSWORD="pw ', c_name, '"') WHEN 1 THEN concat('API_TOKEN: tok-', c_custkey % 500, '-', c_mktsegment)
        WHEN 2 THEN '# OLD_TOKEN=abcdefghijk' WHEN 3 THEN concat('DB_USER=someone', c_custkey)
        WHEN 4 THEN concat('DATABASE_URL=postgres://u', c_custkey, ':pass', c_custkey, 'word@db:5432/x') WHEN 5 THEN 'SHORT_KEY=abc'
        WHEN 6 THEN 'TIGHT_TOKEN:abcdefghijk' WHEN 7 THEN 'SECRET_KEY=$OTHER_VALUE' WHEN 8 THEN concat('  SESSION_SECRET = ''', c_name, '''  ')
        ELSE concat('words PASSWORD=', c_name) END AS text FROM {0}"""),
    "ini_lines": ("supplier", """SELECT concat('/etc/s', s_nationkey, '.conf') AS path, s_suppkey AS line, CASE s_suppkey % 5
        WHEN 0 THEN concat('[trunk-', s_suppkey, ']') WHEN 1 THEN concat('password = ', s_name) WHEN 2 THEN concat('; secret=', s_name)
        WHEN 3 THEN concat('Secret => "', s_name, '"') ELSE 'type=friend' END AS text FROM {0}"""),
    "shadow": ("customer", """SELECT concat('user', c_custkey, ':', CASE WHEN c_custkey % 4 = 0 THEN '*' ELSE '$y$hash' END, ':',
        CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN '0' ELSE CAST(19000 + c_custkey % 900 AS STRING) END, ':0:99999') AS value FROM {0}"""),
    "access_log": ("events", """SELECT concat(strftime_, ' ', CASE event_id % 6 WHEN 0 THEN 'put' WHEN 1 THEN 'get' WHEN 2 THEN 'get' WHEN 3 THEN 'list' WHEN 4 THEN 'rm' ELSE 'bad' END,
        ' ', CASE WHEN event_id % 6 = 3 THEN '-' ELSE concat('name-', user_id) END, ' pid=', event_id, ' uid=', user_id % 7) AS value
        FROM (SELECT *, concat(CAST(CAST(ts AS DATE) AS STRING), 'T00:00:00Z') AS strftime_ FROM {0})"""),
    "handle_turns": ("conversations", """SELECT conv_id, turn, role, concat(text, CASE WHEN turn % 2 = 0 THEN concat(' use $', '{{SECRET:name-', conv_id % 90, '}} now') ELSE '' END,
        CASE WHEN conv_id % 3 = 0 THEN concat(' pw-', conv_id % 40, '-longvalue') ELSE '' END) AS text FROM {0}"""),
    # Some users paste a key; some turns give back its middle, some only a bit that is too short to tell.
    "part_turns": ("conversations", """SELECT conv_id, turn, role, concat(text, CASE WHEN role = 'user' AND conv_id % 3 <> 0 THEN concat(' it is sk-', sha256_(CAST(conv_id % 500 AS STRING)), ' ok') WHEN role = 'assistant' AND turn % 4 = 1
        THEN concat(' you said x', substr(concat('sk-', sha256_(CAST(conv_id % 500 AS STRING))), 21, CASE WHEN conv_id % 2 = 0 THEN 24 ELSE 10 END)) ELSE '' END) AS text FROM {0}"""),
    "changes": ("lineitem", """SELECT substr(sha256_(CAST(l_orderkey AS STRING)), 1, 8) AS commit, concat('src/', CASE l_partkey % 12 WHEN 0 THEN '.env' WHEN 1 THEN '.env.example'
        WHEN 2 THEN 'id_rsa' WHEN 3 THEN 'certs/site.pem' WHEN 4 THEN 'LICENSE' WHEN 5 THEN 'LICENSE.md' WHEN 6 THEN 'data.sqlite3' ELSE concat('m', l_partkey % 50, '.py') END) AS path,
        CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END AS status, l_linenumber % 5 = 0 AS is_binary, l_linenumber % 3 AS n_hunks,
        l_linenumber AS line, CASE l_suppkey % 9 WHEN 0 THEN '3. Grant of Patent License. Subject to' WHEN 1 THEN '  11. Patents.' WHEN 2 THEN '## Patents ' WHEN 3 THEN 'call +1 (555) 555-0123' ELSE concat('x = ', l_suppkey) END AS text FROM {0}"""),
    "commands": ("events", """SELECT event_id AS cmd_id, CASE user_id % 16 WHEN 0 THEN 'git push --no-verify origin main' WHEN 1 THEN 'git commit --no-verify -m x' WHEN 2 THEN 'cd x && git config --global core.hooksPath /tmp'
        WHEN 3 THEN 'git config --get core.hooksPath' WHEN 4 THEN 'echo hi > ~/.gitconfig' WHEN 5 THEN 'GIT_CONFIG_NOSYSTEM=1 git push' WHEN 6 THEN 'gh repo create x --public'
        WHEN 7 THEN 'gh release create v1 -R Acme/site' WHEN 8 THEN 'gh release create v1' WHEN 9 THEN 'gh release upload v1 f --repo acme/other' WHEN 10 THEN 'cargo publish --dry-run; npm publish'
        WHEN 11 THEN 'git -c core.hooksPath=/dev/null push' WHEN 12 THEN '"git"  push | tee log' WHEN 13 THEN 'rm -f /etc/gitconfig' WHEN 14 THEN 'python3 -m twine upload dist/x' ELSE concat('ls ', event_type) END AS command FROM {0}"""),
    # Commands that write somewhere, with the words they write to listed in `shell_writes`.
    "shell_commands": ("events", """SELECT event_id AS cmd_id, CASE user_id % 14 WHEN 0 THEN 'cp a b /etc/git*' WHEN 1 THEN 'rm -rf build dist' WHEN 2 THEN 'sed -i s/a/b/ .git/conf*'
        WHEN 3 THEN 'sed s/a/b/ in.txt > out.txt' WHEN 4 THEN 'dd if=/dev/zero of=disk.img' WHEN 5 THEN 'ls | tee -a log.txt copy.txt' WHEN 6 THEN 'echo x >> /etc/vigil/allow'
        WHEN 7 THEN 'sed -i "s/.git*//" notes' WHEN 8 THEN 'make 2>err.log' WHEN 9 THEN 'gh api -X PUT repos/a/b/contents/x -f m=1' WHEN 10 THEN 'gh api repos/a/b/contents/x'
        WHEN 11 THEN 'mv new ~/.gitconfig' WHEN 12 THEN 'git log --since=x --$OPT' ELSE concat('grep -r x* ', event_type) END AS command FROM {0}"""),
    # A simple command for each rule, and some that only look like one, behind and before others.
    "composed": ("events", """SELECT event_id AS cmd_id, event_type, concat(element_at(array('', 'cd /srv; ', 'time ', 'FOO=1 ', '(date) '), CAST(event_id % 5 AS INT) + 1), CASE user_id % 37 WHEN 0 THEN 'git push --no-verify origin b' WHEN 1 THEN 'git commit --no-verify -m x'
        WHEN 2 THEN 'git fetch --no-veri' WHEN 3 THEN 'git config --global -e' WHEN 4 THEN 'git config --remove-section core' WHEN 5 THEN 'git config core.hooksPath /tmp' WHEN 6 THEN 'git config --get core.hooksPath'
        WHEN 7 THEN 'git config --get --unset core.hooksPath' WHEN 8 THEN 'echo x > /etc/gitconfig' WHEN 9 THEN 'tee -a ~/.gitconfig' WHEN 10 THEN 'sed -i s/a/b/ .git/config' WHEN 11 THEN 'cp x /root/.gitconfig'
        WHEN 12 THEN 'cp gitconfig /etc/' WHEN 13 THEN 'mv config repo/.git/' WHEN 14 THEN 'dd if=x of=.git/config' WHEN 15 THEN 'rm -f /etc/gitconfig' WHEN 16 THEN 'gh repo create x --public'
        WHEN 17 THEN 'gh repo edit x --visibility public' WHEN 18 THEN 'gh gist create -p f' WHEN 19 THEN 'gh api -X PUT repos/a/b/contents/x' WHEN 20 THEN 'gh api -X PATCH repos/a/b -f private=false'
        WHEN 21 THEN 'gh api -X POST user/repos -f name=x' WHEN 22 THEN 'gh api -X PATCH repos/a/b --input f.json' WHEN 23 THEN 'gh release create v1' WHEN 24 THEN 'gh release upload v1 f -R acme/other'
        WHEN 25 THEN 'gh release create v1 --repo Acme/Site' WHEN 26 THEN 'cargo publish' WHEN 27 THEN 'npm publish' WHEN 28 THEN 'npm publish --dry-run' WHEN 29 THEN 'twine upload dist' WHEN 30 THEN 'GIT_CONFIG_NOSYSTEM=1 git push'
        WHEN 31 THEN 'git -c core.hooksPath=/x push' WHEN 32 THEN 'GIT_CONFIG_KEY_0=core.hooksPath git push' WHEN 33 THEN 'git log --$OPT' WHEN 34 THEN 'gh repo edit x --visibility private' WHEN 35 THEN '"git"  push --no-"verify"'
        ELSE concat('ls ', event_type) END, element_at(array('', ' && echo ok', ' | cat; gh release create v2'), CAST(event_id % 3 AS INT) + 1)) AS command FROM {0}"""),
    "wg_lines": ("customer", """SELECT concat('/etc/wg/n', c_nationkey, '.conf') AS path, c_custkey AS line, CASE c_custkey % 7
        WHEN 0 THEN '[Peer]' WHEN 1 THEN concat('PresharedKey = ', c_name, '=') WHEN 2 THEN concat('AllowedIPs = 10.0.', c_custkey % 250, '.2/32, ::1') WHEN 3 THEN concat('AllowedIPs=10.1.', c_custkey % 250, '.0/24')
        WHEN 4 THEN '[Interface]' WHEN 5 THEN concat('PrivateKey=', c_mktsegment, c_custkey, '==') ELSE concat('# PresharedKey = ', c_name) END AS text FROM {0}"""),
    "token_files": ("customer", """SELECT concat('/run/n', c_custkey, '.token') AS path, CASE c_custkey % 3 WHEN 0 THEN concat('  tok-', c_name, chr(10), chr(10)) WHEN 1 THEN concat(chr(9), ' ', chr(10))
        ELSE concat('first ', c_name, chr(10), 'second') END AS content FROM {0}"""),
    "tags": ("orders", """SELECT o_custkey AS push_id, concat('a', o_orderkey) AS sha, CASE o_orderkey % 3 WHEN 0 THEN concat('a', o_orderkey) WHEN 1 THEN NULL ELSE 'older' END AS remote_sha,
        CASE o_orderkey % 5 WHEN 0 THEN 'commit' ELSE 'tag' END AS kind, concat('object x', chr(10), 'tagger t', chr(10), chr(10), 'release ', o_orderpriority, chr(10), chr(10), 'notes') AS body FROM {0}"""),
    "patches": ("documents", """SELECT doc_id AS commit, concat('subject of ', doc_id, chr(10), 'diff --git a/x b/x', chr(10), '--- a/x', chr(10), '+++ b/f', doc_id % 7, chr(10), '@@ -0,0 +1 @@', chr(10),
        '+', replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), '+') ELSE concat(chr(10), ' ') END)) AS patch FROM {0}"""),
    "message_log": ("lineitem", """SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS line, CASE l_linenumber WHEN 1 THEN concat('commit ', l_orderkey) WHEN 4 THEN concat('tag ', l_orderkey) ELSE concat('line ', l_partkey) END AS text,
        l_linenumber NOT IN (1, 4) AND l_partkey % 5 = 0 AS hit FROM {0}"""),
    "tool_calls": ("events", """SELECT concat('{{"tool_input": {{', CASE user_id % 4 WHEN 0 THEN '"command": "ls"' WHEN 1 THEN concat('"file_path": "/etc/vigil/', event_type, '"') WHEN 2 THEN '"file_path": "/etc/vigilant"'
        ELSE '"file_path": "/etc/vigil"' END, '}}}}') AS value FROM {0}"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = VIEWS[name]
    sql = re.sub(r"sha256_\((CAST\([^()]* AS STRING\))\)", r"sha2(\1, 256)", sql)
    return spark.sql(sql.format(f"parquet.`{sf_dir}/{table}.parquet`"))


def view_sql(name: str) -> str:
    table, sql = VIEWS[name]
    return sql.replace("sha256_(", "sha256(").replace("element_at(array(", "list_extract(list_value(").format(table)
