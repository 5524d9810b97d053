-- uses: order_samples
select doc_id, seq, name, content from order_samples
