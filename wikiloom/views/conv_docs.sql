select 'conv-'||conv_id package, 'index.md' path, '# Conversation '||conv_id||chr(10)||chr(10)||'## Contents'||chr(10)||chr(10)||@AGG('1. [Turn '||turn||'](parts/'||turn||'.md)',chr(10),turn)@||chr(10)||chr(10)||'## Notes'||chr(10)||chr(10)||'See [first](parts/0.md).'||chr(10) text from conversations group by conv_id
union all select 'conv-'||conv_id, 'parts/'||turn||'.md', '---'||chr(10)||case role when 'user' then 'type: chat-part'||chr(10)||'parent: ../index.md' when 'assistant' then 'type: chat-part' else 'title: system' end||chr(10)||'---'||chr(10)||chr(10)||'## Turn '||turn||chr(10)||chr(10)||text||chr(10)||chr(10)||'Back to [start](0.md).'||chr(10) from conversations where (conv_id+turn)%7<>6
