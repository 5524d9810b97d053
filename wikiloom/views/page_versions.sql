select cast(user_id as string) page_id, row_number() over (partition by user_id order by ts,event_id) version, event_type client, ts, event_id from events
